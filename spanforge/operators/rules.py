"""Rule detectors: patterns to spans, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import SPANS, disjoint, regex_spans, uncontained

#: Patterns that stop at digits or Latin letters, so that Korean particles may follow.
ID13 = r"(?<![0-9])[0-9]{6}-?[0-9]{7}(?![0-9])"
LICENCE = r"(?<![0-9])[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}(?![0-9])"
PASSPORT = r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![0-9A-Za-z])"
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9]+[.][A-Za-z]+"
QUAD = r"(?<![0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?![0-9.])"
CARD = r"(?<![0-9])[0-9]{16}(?![0-9])"
TEXT_RULES = {"email": EMAIL, "quad": QUAD, "card": CARD}
ID_RULES = {"id13": ID13, "licence": LICENCE, "passport": PASSPORT}


#: A character that every match of a pattern has: texts without it are not searched.
MARKS = {EMAIL: "@", QUAD: "."}


def found(text: Column | str, rules: dict[str, str]) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    of = lambda p, n: F.when(F.contains(t, F.lit(MARKS[p])), regex_spans(t, p, n)).otherwise(F.array().cast(SPANS)) if p in MARKS else regex_spans(t, p, n)
    return F.concat(*(of(p, n) for n, p in rules.items())).cast(SPANS)


def detected(text: Column | str) -> Column:
    """Spans of all text rules, disjoint."""
    return disjoint(found(text, TEXT_RULES))


def id_spans(text: Column | str) -> Column:
    """Spans of the identifier rules, those inside another dropped, 13-digit numbers told apart by their seventh digit."""
    t = F.col(text) if isinstance(text, str) else text

    def kind(x: Column) -> Column:
        d = F.substring(F.regexp_replace(F.substring(t, x["start"] + 1, x["end"] - x["start"]), "-", ""), 7, 1)
        return F.when(x["label"] != "id13", x["label"]).when(d.isin("1", "2", "3", "4"), F.lit("resident")).when(d.isin("5", "6", "7", "8"), F.lit("foreign")).otherwise(F.lit("ambiguous"))

    return F.transform(uncontained(found(t, ID_RULES)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("label")))


# Surfaces that look like identifiers, and hints of what a false positive may be
ORDER_NUMBER = r"[0-9]{8}-[0-9]{6}"
STOCK_CODES = r"005930|000660|035420|207940|051910"
DATE_HINT = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{4}\s*년|[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일|[0-9]{1,2}\s*월\s*[0-9]{4}"
AGE_HINT = r"(만\s*)?[0-9]{1,3}\s*(세|살)|^[0-9]{1,3}$"
SEX_HINT = r"(남성|여성|남자|여자|남|여)$"


def surface_kind(value: Column | str) -> Column:
    """What the surface of a span looks like, first that fits."""
    v = F.col(value) if isinstance(value, str) else value
    kinds = (("order", ORDER_NUMBER), ("stock_code", STOCK_CODES), ("date", DATE_HINT), ("age", AGE_HINT), ("sex", SEX_HINT))
    return F.coalesce(*(F.when(v.rlike(p), F.lit(k)) for k, p in kinds), F.lit("other"))


#: Surnames of two syllables.
COMPOUND_SURNAMES = ("남궁", "황보", "제갈", "선우", "사공", "서문")


def korean_name(text: Column | str) -> Column:
    """The name that opens a text before its title and a particle; empty if none does."""
    return F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"^([가-힣]{2,4})\s*씨(?:는|가|의|와|께서|와도|를)", 1)


def surname(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.when((F.length(n) > 2) & F.substring(n, 1, 2).isin(*COMPOUND_SURNAMES), F.substring(n, 1, 2)).otherwise(F.substring(n, 1, 1))
