"""Quantities in French text: typed amounts, and large plain numbers. Arrow-batched, one call per text.

Matches claim their characters: a later, more general kind never overlaps an earlier match. That state
across matches, and their positions, are beyond Spark's regular expression functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from .vectorized import vectorized

# --- Fixed values: number grammar, kinds in order of priority, units and words that rule a plain number out ---
BLANKS = "    "
NUMBER = rf"\d{{1,3}}(?:[{BLANKS}.]\d{{3}})*(?:,\d+)?|\d+(?:[.,]\d+)?"
KINDS = {
    "milliards_eur": rf"({NUMBER})\s*(?:milliards?|mds?|md)\s*(?:d['’]?euros|€|eur)?",
    "millions_eur": rf"({NUMBER})\s*(?:millions?|m)\s*(?:d['’]?euros|€|eur)?",
    "pct": rf"({NUMBER})\s*(?:%|pour\s*cent|pourcent)",
    "ans": rf"({NUMBER})\s*ans?\b",
    "eur": rf"({NUMBER})\s*(?:€|euros?)\b",
}
PLAIN = rf"\b({NUMBER})\b"
OTHER_UNIT = (
    r"\s*(?:de\s+|d['’])?(?:jours?|journ[ée]es?|mois|heures?|semaines?|minutes?|secondes?|euros?|€|%|amendements?|"
    r"sous[-\s]?amendements?|articles?|pages?|degr[ée]s?|km|kg|m[²2]|litres?)\b"
)
VICTIMS = r"bless[ée]s?|morts?|tu[ée]s?|victimes?|d[ée]c[ée]d"
LEAST, VICTIM_SPAN = 100, 40
# ---

_KINDS = [(k, re.compile(p, re.IGNORECASE)) for k, p in KINDS.items()]
_PLAIN, _UNIT, _VICTIMS = re.compile(PLAIN), re.compile(OTHER_UNIT, re.IGNORECASE), re.compile(VICTIMS, re.IGNORECASE)
_DROP = str.maketrans("", "", BLANKS)

QUANTITY = "struct<value:double,unit_kind:string,raw:string,start:int,end:int>"


def number(raw: str) -> float | None:
    """A comma is the decimal sign; several dots part thousands, one dot is decimal."""
    s = raw.translate(_DROP).replace(",", ".")
    try:
        return float(s.replace(".", "") if s.count(".") > 1 else s)
    except ValueError:
        return None


def typed(text: str) -> list[dict]:
    """Amounts with a unit, by kind, then by position."""
    out: list[dict] = []
    for kind, rx in _KINDS:
        for m in rx.finditer(text):
            value, (a, b) = number(m[1]), m.span()
            if value is not None and not any(q["start"] < b and a < q["end"] for q in out):
                out.append({"value": value, "unit_kind": kind, "raw": m[0].strip(), "start": a, "end": b})
    return out


def plain(text: str, taken: list[dict]) -> list[dict]:
    """Numbers from 100 that stand for a count: no years, no other unit, no victims close by."""
    out = []
    for m in _PLAIN.finditer(text):
        value, (a, b) = number(m[1]), m.span()
        year = value is not None and 1900 <= value <= 2099 and re.fullmatch(r"\d{4}", m[1].strip())
        if value is None or value < LEAST or year or any(q["start"] < b and a < q["end"] for q in taken):
            continue
        if not _UNIT.match(text, b) and not _VICTIMS.search(text[b : b + VICTIM_SPAN]):
            out.append({"value": value, "unit_kind": "nb", "raw": m[0].strip(), "start": a, "end": b})
    return out


@vectorized(f"array<{QUANTITY}>")
def find_quantities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: typed(t or ""))


@vectorized(f"array<{QUANTITY}>")
def find_plain_numbers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: plain(t or "", typed(t or "")))


class Quantities:
    """Table function body: a row for each typed amount of a text."""

    def eval(self, text: str):
        for q in typed(text or ""):
            yield q["value"], q["unit_kind"], q["raw"], q["start"], q["end"]


def quantities_table():
    """The table function, for lateral joins and spark.udtf.register."""
    return F.udtf(Quantities, returnType="value double, unit_kind string, raw string, start int, end int")
