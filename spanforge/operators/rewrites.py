"""Rewrites of texts and values: carrier phrases with shifted spans, and harder surfaces of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import SPANS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _gaps(text: Column, phrase: str) -> Column:
    """What lies between the occurrences of a phrase, from the left."""
    return F.split(text, "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def carriers_rewritten(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """``docs`` (text, spans, any others) with each phrase replaced in turn and spans behind it moved.

    A phrase's occurrences are replaced from the left up to the first that touches a span; that one and
    all behind it stay. An occurrence that a replacement would newly form is not looked for. Empty phrases
    are an error. Null texts and null spans stay null.
    """
    if not all(phrases):
        raise ValueError("a phrase is empty")
    for old, new in phrases.items():
        gaps, n, shift = _gaps(F.col("text"), old), len(old), len(new) - len(old)

        # how many occurrences lie within the first ``to`` characters, by running lengths of the gaps before them
        step = lambda a, gap, to: F.struct((a["at"] + gap + n).alias("at"), (a["k"] + (a["at"] + gap + n <= to).cast("int")).alias("k"))  # noqa: E731, B023
        seen = lambda to: F.aggregate("_lens", F.struct(F.lit(0).alias("at"), F.lit(0).alias("k")), lambda a, gap: step(a, gap, to), lambda a: a["k"])  # noqa: E731, B023
        # of each span that an occurrence touches: how many end before it
        touched = F.transform("spans", lambda s: F.when(seen(s["end"] + n - 1) > seen(s["start"]), seen(s["start"])))  # noqa: B023
        count = F.coalesce(F.array_min(touched), F.size("_gaps") - 1)
        head = F.array_join(F.slice("_gaps", 1, F.col("_n") + 1), new)
        tail = F.slice("_gaps", F.col("_n") + 2, F.size("_gaps"))
        text = F.when(F.size(tail) > 0, F.concat(head, F.lit(old), F.array_join(tail, old))).otherwise(head)
        moved = F.transform("spans", lambda s: F.struct(*((s[k] + F.least(F.col("_n"), seen(s["start"])) * shift).cast("int").alias(k) for k in ("start", "end")), s["label"].alias("label")))  # noqa: B023
        hit = F.col("_n") > 0
        docs = (
            docs.withColumn("_gaps", gaps).withColumn("_lens", F.transform(F.slice("_gaps", 1, F.size("_gaps") - 1), F.length)).withColumn("_n", F.when(F.size("_gaps") > 1, count).otherwise(F.lit(0)))
            .withColumn("spans", F.when(hit, moved).otherwise(F.col("spans")).cast(SPANS)).withColumn("text", F.when(hit, text).otherwise(F.col("text"))).drop("_gaps", "_lens", "_n")
        )
    return docs


# Separators inside values, and how they are spoken
SEPARATORS = "[- .]"
SPOKEN = ["에 ", " 에 ", "이랑 ", " 다시 ", " "]


def _draw(seed: int, n, *keys) -> Column:
    """A whole number from 0 below ``n``, by hash of seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *(_c(k) for k in keys)), _c(n) if not isinstance(n, int) else F.lit(n)).cast("int")


def cut_short(value, seed: int, *keys, words: bool = False) -> Column:
    """A value's first characters, four at least and never all; with ``words`` its first words. What is too short stays."""
    v = _c(value)
    if words:
        parts = F.split(v, " ", -1)
        some = F.slice(parts, 1, 1 + _draw(seed, F.greatest(F.size(parts) - 1, F.lit(1)), *keys))
        return F.when(F.size(parts) > 1, F.array_join(some, " ")).otherwise(v)
    some = F.substring(v, F.lit(1), 4 + _draw(seed, F.greatest(F.length(v) - 4, F.lit(1)), *keys))
    return F.when(F.length(v) > 4, some).otherwise(v)


def spoken(value, seed: int, *keys) -> Column:
    """A value with its separators spoken, one way for the whole value."""
    v = _c(value)
    by = F.element_at(F.array(*(F.lit(s) for s in SPOKEN)), 1 + _draw(seed, len(SPOKEN), *keys))
    return F.when(v.rlike(SEPARATORS), F.call_function("array_join", F.filter(F.split(v, SEPARATORS, -1), lambda p: p != ""), by)).otherwise(v)


def respaced(value, seed: int, *keys) -> Column:
    """A value with its separators as spaces, gone, or each by its own draw; without any, a space inside if over four characters."""
    v = _c(value)
    parts, marks = F.split(v, SEPARATORS, -1), F.regexp_extract_all(v, F.lit(f"({SEPARATORS})"), F.lit(1))
    each = F.transform(marks, lambda m, i: F.element_at(F.array(F.lit(" "), F.lit(""), m), 1 + _draw(seed + 1, 3, i, *keys)))
    mixed = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(each, lambda m, i: F.concat(m, F.get(parts, i + 1))), ""))
    mode, at = _draw(seed, 3, *keys), 2 + _draw(seed, F.greatest(F.length(v) - 3, F.lit(1)), *keys)
    marked = F.when(mode == 0, F.regexp_replace(v, SEPARATORS, " ")).when(mode == 1, F.regexp_replace(v, SEPARATORS, "")).otherwise(mixed)
    inside = F.concat(F.substring(v, F.lit(1), at), F.lit(" "), F.substring(v, at + 1, F.length(v)))
    return F.when(v.rlike(SEPARATORS), marked).when(F.length(v) > 4, inside).otherwise(v)
