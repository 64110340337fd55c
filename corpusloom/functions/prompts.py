"""Chat records from labelled texts, and model replies parsed to label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def system_message(types: Column) -> Column:
    return F.concat(F.lit("Find: "), F.when(types.isNull(), "all").otherwise(F.array_join(F.array_sort(types), ", ")))


def chat(df: DataFrame, text_col: str, types_col: str, map_col: str) -> DataFrame:
    """Adds ``messages``: system (the types asked for), user (the text), assistant (the labels as compact JSON)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.withColumn("messages", F.array(message("system", system_message(F.col(types_col))), message("user", F.col(text_col)), message("assistant", F.to_json(map_col))))


def parse_output(reply: Column) -> Column:
    """The label map in a reply: thinking is cut, the outermost braces are read, a value may be a list or one string; what has another shape
    becomes an empty list, and a reply without a readable object gives null."""
    bare = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    body = F.regexp_substr(bare, F.lit(r"(?s)\{.*\}"))
    raw = F.from_json(body, "map<string,string>")
    none = F.array().cast("array<string>")
    return F.transform_values(raw, lambda _, v: F.when(v.isNull(), None).when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), none)).when(v.startswith("{"), none).otherwise(F.array(v)))
