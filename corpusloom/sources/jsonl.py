"""Readers and writers: tolerant JSON lines, additions, edit layers, raw text folders, sharded records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records (text_input, output) of JSON lines, and the lines that are none.

    Blank lines are skipped. A value of ``output`` that is no list of values is null for its type alone. Lines without a readable
    object or without text_input, a torn last line among them, are in the second table with their file.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path")).withColumn("v", F.try_parse_json("value"))
    text = F.try_variant_get("v", "$.text_input", "string")
    raw = F.try_variant_get("v", "$.output", "map<string,variant>")
    output = F.transform_values(raw, lambda _, x: F.try_variant_get(x, "$", "array<string>"))
    read = lines.select("value", "file", text.alias("text_input"), output.alias("output"))
    return read.where("text_input is not null").drop("value"), read.where("text_input is null").select("file", "value")


def read_strict(spark: SparkSession, paths: list[str], known: list[str]) -> DataFrame:
    """Labelled records (id, text_input, output, types) of JSON lines in the order of their files; types without spans are dropped.

    A line that is no object with an id and a text, or a label type that is not ``known``, raises: training data is not guessed.
    """
    lines = spark.read.text(paths).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path")).withColumn("v", F.try_parse_json("value"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    t = lines.select("file", "value", get("$.id", "string").alias("id"), get("$.text_input", "string").alias("text_input"), get("$.output", "map<string,array<string>>").alias("output"), get("$.types", "array<string>").alias("types"))
    if bad := t.where("id is null or text_input is null or output is null").select("file", F.substring("value", 1, 80)).limit(3).collect():
        raise ValueError(f"no labelled records: {bad}")
    if odd := t.select("id", F.explode(F.map_keys("output")).alias("etype")).where(~F.col("etype").isin(known)).limit(3).collect():
        raise ValueError(f"unknown label types: {odd}")
    return t.orderBy("file").select("id", "text_input", F.map_filter("output", lambda _, v: F.size(v) > 0).alias("output"), "types")


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One record for each key: the last in order of file name and place."""
    t = spark.read.schema(schema).json(path).withColumns({"_f": F.col("_metadata.file_path"), "_n": F.monotonically_increasing_id()})
    w = Window.partitionBy(key).orderBy(F.col("_f").desc(), F.col("_n").desc())
    return t.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_f", "_n")


def read_additions(spark: SparkSession, path: str) -> DataFrame:
    """Added labels (id, type, span) of tab-separated files without header and quoting."""
    return spark.read.schema("id string, type string, span string").csv(path, sep="\t", quote="", escape="")


def read_layer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An edit layer of JSON lines; an empty table if there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(slug, prompt, text) of a folder of one text file for each prompt."""
    t = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.split(F.col("_metadata.file_path"), "/").alias("p"))
    return t.select(F.element_at("p", -2).alias("slug"), F.regexp_replace(F.element_at("p", -1), r"\.txt$", "").alias("prompt"), "text")


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, characters unescaped."""
    df.write.json(path)


def write_shards(df: DataFrame, path: str, size: int, order: str) -> None:
    """JSON lines in folders of about ``size`` records, by ranges of the order column: ``shard`` is the range's number."""
    n = max(1, -(-df.count() // size))
    parts = df.repartitionByRange(n, order).withColumn("shard", F.spark_partition_id())
    parts.write.partitionBy("shard").json(path)
