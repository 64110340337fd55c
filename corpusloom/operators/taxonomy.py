"""Conversion of legacy label types to the second taxonomy, and its layers of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.context import W, before, full, nearest, whole

# One-to-one renamings.
RENAME = {
    "PERSON": "PERSON",
    "NO_ADDRESS": "ADDRESS",
    "POSTAL_CODE": "POSTAL_CODE",
    "NO_PHONE_NUMBER": "PHONE",
    "EMAIL_ADDRESS": "EMAIL",
    "CRIMINAL_RECORD": "CRIMINAL",
    "POLITICAL_CASE": "POLITICAL",
    "ECONOMIC_STATUS": "ECONOMIC_STATUS",
    "SEXUAL_ORIENTATION": "SEXUAL_ORIENTATION",
    "BEHAVIORAL_PATTERN": "BEHAVIORAL_PATTERN",
    "RELIGIOUS_BELIEF": "RELIGIOUS_BELIEF",
}
UNRESOLVED = "UNRESOLVED"
# Authorities inside an identifier, labels before one (the nearest decides), registered objects, shapes.
AUTHORITY = "tingrett|lagmannsrett|politistasjon|politidistrikt|skatteetaten"
GOV_LABELS = [
    (rf"våpen{W}*\s*nr|våpenkort{W}*|lisensnummer|license number|permit number", "FIREARMS_LICENSE"),
    (rf"fiskebåt|fiskefartøy{W}*|fishing vessel|vessel", "VESSEL_REGISTRATION"),
    ("førerkort", "DRIVER_LICENSE"),
    (r"pass\s*nr|passnummer|pass\s*nummer", "PASSPORT"),
    ("id-kort|nasjonalt id", "IDENTITY_CARD"),
    ("visum|oppholdstillatelse", "VISA_NUMBER"),
    ("militær|tjenestenummer", "MILITARY_ID"),
    ("autorisasjon|hpr", "MEDICAL_LICENSE"),
    ("skatte-?id|skattenummer|ligningsnummer", "TAX_ID"),
    (rf"registre{W}*nummer|reg\.?\s*nr|skiltnummer|kjennemerke", "LICENSE_PLATE"),
    ("fødselsnummer|personnummer|d-nummer|fnr", "NATIONAL_ID"),
    (r"org\.?\s*nr|organisasjonsnummer|orgnr", "ORG_NUMBER"),
    (r"sak|ref(?:[^\p{L}\p{N}_]|\z)|referansenummer|case id|dom|anmeld|tingrett|politi|journal", "CASE_NUMBER"),
]
WEAPON = "rifle|hagle|haglegevær|haglgevær|gevær|våpen|pistol|revolver"
VESSEL = r"fiskefartøy|fiskebåt|fartøy|vessel|(?:\A|[^\p{L}\p{N}_])ms(?:[^\p{L}\p{N}_]|\z)"
CASE_SHAPE = r"[0-9]{4}[/-][0-9]{2,}|[0-9]{2,}[/-][0-9]{4}|tingrett|lagmannsrett|politi"
# Shapes of accounts.
_S = r"[\s\x{A0}]"
IBAN = full(rf"(?i)NO{_S}?[0-9]{{2}}(?:{_S}?[0-9]{{4}}){{2,3}}{_S}?[0-9]{{0,3}}")
CARD = full(r"(?:[0-9]{4}[\s\x{A0}-]?){3}[0-9]{4}")
ACCOUNT = full(r"[0-9]{4}[\s\x{A0}.]?[0-9]{2}[\s\x{A0}.]?[0-9]{5}")
CRYPTO = full("(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,62}")
NUMBER = full(r"[0-9\s\x{A0}.]{8,}")
ACCOUNT_CUE = "konto|lånenummer|lånenr"
# Words of medication, diagnoses, disability, animals, roles, organisations, marital status and kin.
MEDICATION = whole(rf"antidepressiv{W}*|insulin{W}*|metformin|sertralin|medisiner|medisinen|medisinene|medikament{W}*|tabletter|smertestillende|beroligende|sovemedisin{W}*|lithium|ritalin|reseptbelagte")
DIAGNOSIS = whole(rf"diabetes|depresjon|angst|bipolar|schizofreni|kreft|astma|epilepsi|adhd|diagnos{W}*|lidelse|sykdom|demens|ptsd")
DISABILITY = whole(rf"funksjonshemm{W}*|bevegelseshemm{W}*|rullestol{W}*|synshemm{W}*|hørselshemm{W}*|utviklingshemm{W}*|amputert|blind|døv|cerebral parese|uføre{W}*")
ANIMAL = whole(rf"hund{W}*|katt{W}*|hest{W}*|ku|kyr|sau{W}*|gris{W}*|dyr{W}*|kanin{W}*|fugl{W}*|høn{W}*|valp{W}*|føll|kalv{W}*|geit{W}*|pels|hov{W}*|fisk{W}*|flokk{W}*")
AGE = full(rf"[0-9]{{1,3}}{_S}*år(?:{_S}+gammel)?")
BORN = rf"(?:(?:\A|[^\p{{L}}\p{{N}}_])(?:f\.|født(?:{_S}+den)?|fødd)|fødselsdato|fødselsdag){_S}*:?{_S}*\z"
ROLE = whole(
    "jobber|jobbet|ansatt|arbeider|arbeidet|eier|eid av|eiet|driver|drives av|driftet|daglig leder|leder|sjef|styreleder|innehaver|utdannet|student|pensjonist|"
    rf"pensjonert|frivillig|lærer|lege|sykepleier|veterinær{W}*|bonde|gårdbruker|selvstendig|ufør|arbeidsledig|kokk|sjåfør|tømrer|elektriker|eieren|{W}*direktør|inspektør|"
    rf"{W}*medhjelper|{W}*(?:medarbeider|assistent|pleier|ingeniør|konsulent|rådgiver|mekaniker)"
)
ORGANISATION = whole("as|asa|ans|da|sa|ba|enk") + r"|\A[\"«]|kommune(?:[^\p{L}\p{N}_]|\z)|stiftelse"
CAPITAL = r"\A\p{Lu}"
STATUS = whole("gift|samboer|samboerskap|skilt|separert|ugift|enke|enkemann|partnerskap|forlovet")
KIN = whole(rf"barn|sønn{W}*|datter|døtre|mor|far|foreldre|bror|brødre|søster{W}*|svoger|svigerinne|svigermor|svigerfar|onkel|tante|nevø|niese|barnebarn|bestemor|bestefar|stesønn|stedatter|fosterbarn")
#: Characters before a span that its rule reads.
WIDTHS = {"gov": 45, "object": 90, "account": 30, "born": 14, "parked": 50}


def _bare(span: Column) -> Column:
    return F.regexp_replace(span, r"\A[\s\x{A0}]+|[\s\x{A0}]+\z", "")


def gov_id(span: Column, head: dict[str, Column]) -> Column:
    """By an authority inside the span, the nearest label before it, the registered object for a plate's label, then by shape."""
    low, digits, label, thing = F.lower(span), F.regexp_replace(span, "[^0-9]", ""), head["label"], head["object"]
    packed = F.length(F.regexp_replace(span, "[ -]", ""))
    return (
        F.when(low.rlike(AUTHORITY), "CASE_NUMBER")
        .when((label == "LICENSE_PLATE") & thing.rlike(WEAPON), "FIREARMS_LICENSE")
        .when((label == "LICENSE_PLATE") & thing.rlike(VESSEL), "VESSEL_REGISTRATION")
        .when(label.isNotNull(), label)
        .when((F.length(digits) == 11) & (packed - 1 <= 11), "NATIONAL_ID")
        .when((F.length(digits) == 9) & span.rlike(full(r"[0-9\s\x{A0}]{9,11}")), "ORG_NUMBER")
        .when(low.rlike(CASE_SHAPE), "CASE_NUMBER")
        .otherwise(UNRESOLVED)
    )


def financial(span: Column, head: dict[str, Column]) -> Column:
    """An account, card or wallet only where the span is nothing else."""
    s, cue = _bare(span), head["account"].rlike(ACCOUNT_CUE)
    return F.when(s.rlike(IBAN), "IBAN").when(s.rlike(CARD), "CREDIT_CARD").when(s.rlike(ACCOUNT), "BANK_ACCOUNT").when(s.rlike(CRYPTO), "CRYPTO").when(s.rlike(NUMBER) & cue, "BANK_ACCOUNT").otherwise("FINANCIAL")


def health(span: Column, head: dict[str, Column]) -> Column:
    """Animals' facts stay health; a drug beside a diagnosis does too."""
    low = F.lower(span)
    return F.when(low.rlike(ANIMAL), "HEALTH").when(low.rlike(DISABILITY), "DISABILITY").when(low.rlike(MEDICATION) & ~low.rlike(DIAGNOSIS), "MEDICATION").otherwise("HEALTH")


def date_time(span: Column, head: dict[str, Column]) -> Column:
    return F.when(_bare(span).rlike(AGE), "AGE").when(head["born"].rlike(BORN), "DATE_OF_BIRTH").otherwise("DATE_TIME")


def employment(span: Column, head: dict[str, Column]) -> Column:
    low, s = F.lower(span), _bare(span)
    return F.when(low.rlike(ROLE), "EMPLOYMENT").when(F.lower(s).rlike(ORGANISATION) | s.rlike(CAPITAL), "ORGANIZATION").otherwise("EMPLOYMENT")


def family(span: Column, head: dict[str, Column]) -> Column:
    low = F.lower(span)
    return F.when(low.rlike(STATUS) & ~low.rlike(KIN), "MARITAL_STATUS").otherwise("FAMILY_RELATION")


#: Registry of splits: legacy type -> type by span and the text before it; and which type reads which head.
SPLIT = {"GOV_ID": gov_id, "FINANCIAL_INFO": financial, "HEALTH_INFO": health, "DATE_TIME": date_time, "EMPLOYMENT_INFO": employment, "FAMILY_RELATION": family}
_READS = {"gov": "GOV_ID", "object": "GOV_ID", "account": "FINANCIAL_INFO", "born": "DATE_TIME"}


def convert(df: DataFrame, etype: str = "etype", span: str = "span", text: str = "text") -> DataFrame:
    """``df`` with ``new_type``: UNRESOLVED where the type is unknown or no rule decides. A null text counts as empty.

    The heads are columns of their own, so that each is searched once.
    """
    whole_text = F.coalesce(F.col(text), F.lit(""))
    x = df.withColumns({f"_{k}": F.when(F.col(etype) == t, F.lower(before(whole_text, F.col(span), WIDTHS[k]))) for k, t in _READS.items()})
    x = x.withColumn("_label", F.when(F.col(etype) == "GOV_ID", nearest(F.col("_gov"), GOV_LABELS)))
    head = {k: F.col(f"_{k}") for k in (*_READS, "label")}
    out = F.lit(UNRESOLVED)
    for old, new in RENAME.items():
        out = F.when(F.col(etype) == old, new).otherwise(out)
    for old, rule in SPLIT.items():
        out = F.when(F.col(etype) == old, rule(F.col(span), head)).otherwise(out)
    return x.withColumn("new_type", out).drop(*[f"_{k}" for k in head])


def migrate(labels: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Long-form labels (id, text, etype, span) with ``new_type``: the override of (id, etype, span) if there is one, else by the rules.

    ``overrides`` has (id, etype, span, new_type); of several for a key the first in order counts. Null and empty spans are left out.
    """
    x = convert(labels.where("span is not null and span <> ''"))
    if overrides is None:
        return x
    o = overrides.groupBy("id", "etype", "span").agg(F.min("new_type").alias("override"))
    return x.join(o, ["id", "etype", "span"], "left").withColumn("new_type", F.coalesce("override", "new_type")).drop("override")


def migrated(moved: DataFrame) -> DataFrame:
    """(id, type, span): resolved labels, each once a record."""
    return moved.where(F.col("new_type") != UNRESOLVED).select("id", F.col("new_type").alias("type"), "span").distinct()


def relabel_counts(moved: DataFrame) -> DataFrame:
    """(etype, new_type, spans): how many spans went where, dropped ones as UNRESOLVED."""
    return moved.groupBy("etype", "new_type").agg(F.count("*").alias("spans"))


def parked(moved: DataFrame) -> DataFrame:
    """(id, etype, span, context): spans that no rule placed, with the text before them, for a decision later.

    Only identifiers and unknown types can be among them (no override says UNRESOLVED), so no other label's rule is run.
    """
    open_types = (F.col("etype") == "GOV_ID") | ~F.col("etype").isin([*RENAME, *SPLIT])
    x = moved.where(open_types).where(F.col("new_type") == UNRESOLVED)
    return x.select("id", "etype", "span", before(F.coalesce("text", F.lit("")), F.col("span"), WIDTHS["parked"]).alias("context"))


def correct(labels: DataFrame, corrections: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels (id, type, span) with corrections (id, type, old, new): ``old`` goes, ``new`` comes if it is not null or empty.

    ``texts`` is (id, text). A correction whose ``old`` is missing or whose ``new`` does not stand in the text raises.
    """
    c = corrections.select("id", "type", "old", "new").distinct()
    lost = c.join(labels.select("id", "type", F.col("span").alias("old")), ["id", "type", "old"], "left_anti")
    fresh = c.where("new is not null and new <> ''")
    loose = fresh.join(texts.select("id", "text"), "id", "left").where(~F.coalesce(F.contains("text", "new"), F.lit(False)))
    refuse(lost, "correction target not found")
    refuse(loose, "correction is not verbatim")
    kept = labels.select("id", "type", "span").join(c.select("id", "type", F.col("old").alias("span")), ["id", "type", "span"], "left_anti")
    return kept.unionByName(fresh.select("id", "type", F.col("new").alias("span"))).distinct()


def refuse(rows: DataFrame, why: str) -> None:
    """Raise with a few of the rows, if there are any."""
    if some := rows.limit(3).collect():
        raise ValueError(f"{why}: {some}")


def add_layer(labels: DataFrame, additions: DataFrame, keys: list[str], known: list[str] | None = None) -> DataFrame:
    """Long-form labels with the additions' rows that they lack, each once; ``added`` tells which. With ``known``, an addition of another type raises."""
    if known is not None:
        refuse(additions.where(~F.col("type").isin(known)), "addition type is not in the taxonomy")
    base = labels.select(*keys).distinct().withColumn("added", F.lit(False))
    new = additions.select(*keys).distinct().join(base.select(*keys), keys, "left_anti").withColumn("added", F.lit(True))
    return base.unionByName(new)
