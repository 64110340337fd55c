"""Sweep for structured personal data: every shape with its place, and without findings inside others."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONTHS = "januar|februar|mars|april|mai|juni|juli|august|september|oktober|november|desember"
_MONTH_ABBR = "jan|feb|mar|apr|jun|jul|aug|sep|sept|okt|nov|des"
_LABEL_TO_VALUE = r"(?:[ \t]*[:=][ \t]*|[ \t]+(?:er|var|på)[ \t]+|[ \t]+)"
_FIREARMS = (
    r"(?i:våpenkort(?:nummer(?:et)?|[ \t]+nr\.?)?|lisens(?:nummer(?:et)?|[ \t]?nr\.?)|våpenlisens(?:nummer(?:et)?)?"
    r"|registreringsnummer(?:et)?[ \t]+i[ \t]+våpenregisteret|permit[ \t]+ID|(?:licen[sc]e|permit)[ \t]+number)"
)
_VESSEL = r"(?i:reg(?:istrerings)?\.?[ \t]?nr\.?|registreringsnummer(?:et)?|registreringsmerke(?:t)?|registrert(?:[ \t]+som)?|kjennemerke(?:t)?|fiskerimerke(?:t)?)"

#: Values known by the label before them; the finding is the value alone. They go before the shapes: of two findings at one place the first stays.
LABELLED = {
    "firearms_like": _FIREARMS + _LABEL_TO_VALUE + r"((?:[A-Z]{1,2}-)?[A-Z]{0,2}\d[\d\-]{2,}\d)(?![\w\-])",
    "vessel_like": _VESSEL + _LABEL_TO_VALUE + r"([A-ZÆØÅ]{1,2}-\d{1,4}(?:-[A-ZÆØÅ]{1,2})?|[A-Z]\d{5})(?![\w\-])",
}
SHAPES = {
    "fnr_like": r"(?<![\d.])\d{6}[ \t]?\d{5}(?!\d)",
    "org_like": r"(?<![\d.])(?:\d{9}|\d{3} \d{3} \d{3})(?!\d)",
    "account_like": r"(?<!\d)\d{4}\.\d{2}\.\d{5}(?!\d)",
    "phone_like": r"(?<![\d/.,])(?:\+47[ \t-]?)?(?:[2-9]\d{7}|\d{2}(?:[ \t-]\d{2}){3}|\d{3}[ \t]\d{2}[ \t]\d{3}|\d{4}[ \t]\d{4})(?![\d/])",
    "email_like": r"\b[\w.\-]+@[\w.\-]+\.\w{2,}\b",
    "postal_like": r"(?<![\d.,/\-])(\d{4})[ \t]+([A-ZÆØÅ][a-zæøå]+)\b",
    "plate_like": r"\b[A-Z]{2}[ \t]?\d{5}\b",
    "iban_like": r"\bNO\d{2}[ \t]?(?:\d{4}[ \t]?){2}\d{3}\b",
    "url_like": r"https?://\S*[^\s.,;:!?)\]»\"']|\bwww\.\S*[^\s.,;:!?)\]»\"']",
    "ip_like": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "mac_like": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
    "ipv6_like": r"\b(?:[0-9a-fA-F]{1,4}:){2,7}(?::|[0-9a-fA-F]{1,4})\b",
    "long_digit_run": r"(?<![\d.,/\-])\d{10,19}(?![\d])",
    "document_number_like": r"\b[A-Z]{1,2}\d{7,8}\b",
    "wallet_like": r"\b(?:bc1[023456789acdefghjklmnpqrstuvwxyz]{20,}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b",
}
DATES = (
    r"(?<![\d.])\d{1,2}\.[ \t]?\d{1,2}\.[ \t]?(?:\d{4}|\d{2})(?!\d)(?!\.\d)",
    rf"(?i)(?<!\d)\d{{1,2}}\.[ \t]?(?:{_MONTHS}|(?:{_MONTH_ABBR})\.?)[ \t]+\d{{4}}\b",
    r"\b(?:19|20)\d{2}-[01]\d-[0-3]\d\b",
)
AGE = (
    r"(?:(?<=\ber )|(?<=\bvar )|(?<=\bvert )|(?<=\bblir )|(?<=\bblei )|(?<=\()|(?<=\balder )|(?<=\balderen )|(?<=\balder: )|(?<=\bAlder: ))"
    r"\d{1,3} år(?: gammel| gammal)?(?!\w)|\b\d{1,3} år gam(?:mel|mal)\b|\b\d{1,3}-åri(?:g|ng)(?:e|en)?\b"
)
_HOUR = r"(?:[01]?\d|2[0-3])"
_TIME = _HOUR + r"[:.][0-5]\d(?::[0-5]\d)?"
_CLOCK_END = r"(?![\d:])(?![.,]\d)(?![ \t]*[–\-][ \t]*\d)(?![ \t]+til[ \t]+\d)"
CLOCK = rf"(?i)[ \t]+(?:kl\.?|klokka|klokken)[ \t]*(?:{_TIME}(?:[ \t]*[–\-][ \t]*|[ \t]+til[ \t]+){_TIME}{_CLOCK_END}|{_TIME}{_CLOCK_END}|{_HOUR}{_CLOCK_END})"
#: Words after four digits that begin a field and are no post town.
FIELD_LABELS = frozenset(
    "Deres Vår Org Ref Referanse Adresse Address Personalia Postnummer Poststed Fylke Kommune Telefon Dato Saksnummer Sendt Nei Ja Kl Sak Vedlegg Att Gjelder Navn Fødselsnummer Kontonummer".split()
)

_LABELLED, _SHAPES = ({k: re.compile(p) for k, p in x.items()} for x in (LABELLED, SHAPES))
_DATES, _AGE, _CLOCK = [re.compile(p) for p in DATES], re.compile(AGE), re.compile(CLOCK)
_YEAR = re.compile(r"(?:19|20)\d{2}")
_MONTH_BEFORE = re.compile(rf"(?:{_MONTHS})[ \t]*$", re.IGNORECASE)


def identifiers_in(text: str, places: frozenset = frozenset()) -> list[tuple[str, str, int, int]]:
    """(pattern, match, start, end) of identifiers, without those inside another."""
    out = [(k, m[1], m.start(1), m.end(1)) for k, p in _LABELLED.items() for m in p.finditer(text) if not _YEAR.fullmatch(m[1])]
    for k, p in _SHAPES.items():
        for m in p.finditer(text):
            if k == "postal_like" and (m[2] in FIELD_LABELS or _YEAR.fullmatch(m[1]) and m[2] not in places or _MONTH_BEFORE.search(text[max(0, m.start() - 12) : m.start()])):
                continue
            if k == "phone_like":
                parts = re.findall(r"\d+", m[0].replace("+47", ""))
                if len(parts) == 2 and all(map(_YEAR.fullmatch, parts)):
                    continue
            out.append((k, m[0], m.start(), m.end()))
    out.sort(key=lambda f: (f[2], -f[3]))
    kept, top = [], -1
    for f in out:  # what began earlier and reaches as far holds it
        if f[3] > top:
            kept.append(f)
            top = f[3]
    return kept


def dates_in(text: str) -> list[tuple[str, str, int, int]]:
    """Dates with the clock time after them; date_time_mixed where a date stands with and without one."""
    seen, out = [], []
    for p in _DATES:
        for m in p.finditer(text):
            if any(m.start() < b and a < m.end() for a, b in seen):
                continue
            clock = _CLOCK.match(text, m.end())
            end = clock.end() if clock else m.end()
            seen.append((m.start(), end))
            out.append((m[0], text[m.start() : end], m.start(), end))
    mixed = {d for d, x, _, _ in out if x != d} & {d for d, x, _, _ in out if x == d}
    return [("date_time_mixed" if d in mixed else "date_like", x, a, b) for d, x, a, b in out]


def ages_in(text: str) -> list[tuple[str, str, int, int]]:
    return [("age_like", m[0], m.start(), m.end()) for m in _AGE.finditer(text)]


def findings(df: DataFrame, id_col: str, text_col: str, places: frozenset = frozenset()) -> DataFrame:
    """(id, pattern, match, start_char, end_char) of identifiers, dates and ages; half-open places in code points.

    ``places`` are the post towns before which four digits like a year are a postal code all the same.
    """

    def sweep(batches):
        for pdf in batches:
            rows = [(i, *f) for i, t in zip(pdf["id"], pdf["text"]) for f in (*identifiers_in(t, places), *dates_in(t), *ages_in(t))]
            yield pd.DataFrame(rows, columns=["id", "pattern", "match", "start_char", "end_char"])

    x = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return x.mapInPandas(sweep, "id long, pattern string, match string, start_char long, end_char long").withColumnRenamed("id", id_col)
