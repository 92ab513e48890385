"""Corpus generation: pseudonyms by hash, span-preserving rewrites, difficulty injection, probe values.

Nothing draws from a shared random stream: each value depends on seed, document and original alone,
so partitions and retries do not matter and one original has one pseudonym in a document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import SPANS, luhn, resident_check, span_text
from spanforge.operators import rewrites

#: Digits of each kind; ``#`` stands for a digit.
FORMATS = {"account": "###-##-######", "phone": "010-####-####", "passport": "M########", "licence": "##-##-######-##", "card": "####-####-####-####", "resident": "######-#######"}


def number(seed: int, *keys, digits: int) -> Column:
    """``digits`` digits from the hash of seed and keys."""
    parts = [F.lpad((F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(10**9))).cast("string"), 9, "0") for i in range(-(-digits // 9))]
    return F.substring(F.concat(*parts), 1, digits)


def shaped(kind: str, seed: int, *keys) -> Column:
    """A value in the shape of its kind. Cards never pass Luhn, resident numbers never carry the right check digit."""
    form = FORMATS[kind]
    d = number(seed, F.lit(kind), *keys, digits=form.count("#"))
    if kind == "card":
        body = F.substring(d, 1, 15)
        last = F.coalesce(*(F.when(~luhn(F.concat(body, F.lit(str(i)))), F.lit(str(i))) for i in (0, 1)))
        d = F.concat(body, last)
    if kind == "resident":
        body = F.substring(d, 1, 12)
        d = F.concat(body, F.coalesce(*(F.when(~resident_check(F.concat(body, F.lit(str(i)))), F.lit(str(i))) for i in (0, 1))))
    runs = [len(r) for r in re.findall("#+", form)]
    order = iter(range(1, len(runs) + 1))
    return F.regexp_replace(d, "^" + "".join(f"(.{{{n}}})" for n in runs) + "$", re.sub("#+", lambda _: f"${next(order)}", form))


def weighted(names: list[str], weights: list[float], seed: int, *keys) -> Column:
    """One of ``names`` by cumulative weight."""
    total, acc, out = sum(weights), 0.0, None
    x = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10**9)) / 1e9 * total
    for n, w in zip(names[:-1], weights[:-1]):
        acc += w
        out = F.when(x < acc, F.lit(n)) if out is None else out.when(x < acc, F.lit(n))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def pseudonymized(docs: DataFrame, seed: int = 20) -> DataFrame:
    """``docs(doc_id, text, spans)`` with span values replaced and offsets rebuilt in one fold; spans that start behind the cursor go."""
    t = F.col("text")

    def value(x) -> Column:
        original = span_text(t, x["start"], x["end"])
        out = F.concat(F.lit("N"), number(seed, F.col("doc_id"), x["label"], original, digits=6))
        for kind in FORMATS:
            out = F.when(x["label"] == kind, shaped(kind, seed, F.col("doc_id"), original)).otherwise(out)
        return out

    valued = F.transform(F.array_sort("spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), value(x).alias("value")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(SPANS).alias("spans"))

    def step(a, x):
        head = F.concat(a["out"], F.substring(t, a["at"] + 1, x["start"] - a["at"]))
        span = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(x["value"])).alias("end"), x["label"].alias("label"))
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(head, x["value"]).alias("out"), F.array_append(a["spans"], span).alias("spans"))).otherwise(a)

    made = F.aggregate("_valued", zero, step)
    return (
        docs.withColumn("_valued", valued).withColumn("_made", made)
        .select("doc_id", F.concat("_made.out", F.substring(t, F.col("_made.at") + 1, F.length(t))).alias("text"), F.col("_made.spans").alias("spans"))
    )


def merged_neighbours(spans: Column | str, text: Column | str, gap: int = 4) -> Column:
    """Spans of one label with at most ``gap`` characters of space, comma or middle dot between them become one."""
    t, s = (F.col(x) if isinstance(x, str) else x for x in (text, spans))

    def step(a, x):
        last = F.get(a, F.size(a) - 1)
        between = F.substring(t, last["end"] + 1, x["start"] - last["end"])
        near = (last["label"] == x["label"]) & (x["start"] >= last["end"]) & (x["start"] - last["end"] <= gap) & between.rlike(r"^[\s,·]*$")
        return F.when((F.size(a) > 0) & near, F.array_append(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.struct(last["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))).otherwise(F.array_append(a, x))

    return F.aggregate(F.array_sort(s), F.array().cast(SPANS), step)


#: Difficulty cases by file order, as (case, divisor); several can hold for one document.
CASES = (("even", 2), ("seventh", 7), ("third", 3), ("fourth", 4))


def difficulty(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``docs`` with ``cases`` and the text with one injected sentence for each case."""
    flags = F.filter(F.array(*(F.when(F.col(order) % d == 0, F.lit(n)) for n, d in CASES)), lambda x: x.isNotNull())
    injected = F.transform("cases", lambda c: F.concat(F.lit(" ["), c, F.lit("]")))
    return docs.withColumn("cases", flags).withColumn("text", F.concat("text", F.array_join(injected, "")))


def invalid(kind: Column, value: Column) -> Column:
    """Whether a generated value breaks its kind's check digit (kinds without one always do)."""
    return F.when(kind == "card", ~luhn(value)).when(kind == "resident", ~resident_check(value)).otherwise(F.lit(True))


def surfaces(value: Column, *keys) -> dict[str, Column]:
    """A probe value as it is uttered: cut short, spoken, respaced."""
    return {"cut": rewrites.cut_short(value, 5, *keys, value), "spoken": rewrites.spoken(value, 6, *keys, value), "respaced": rewrites.respaced(value, 7, *keys, value)}


def probes(docs: DataFrame, per_kind: int, seed: int = 11, tries: int = 32) -> DataFrame:
    """(kind, n, text, start, end, value): templates with the first hash candidate whose value and surfaces all have a wrong check digit.

    The documents of a kind's ``per_kind`` probes are drawn by hash among all; if they are fewer, in turn. ``n``
    counts a kind's probes from 0. As in the reference, a cut leaves four digits at least, and a probe without
    a candidate is an error. No documents give no rows.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    bank = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(per_kind).agg(F.array_sort(F.collect_list(F.struct(order.alias("h"), "doc_id"))).alias("bank"))
    slots = bank.filter(F.size("bank") > 0).select("bank", F.explode(F.sequence(F.lit(0), F.lit(per_kind - 1))).alias("i"))
    rows = slots.select(F.col("i").cast("long").alias("n"), F.get("bank", F.col("i") % F.size("bank"))["doc_id"].alias("doc_id"))
    rows = rows.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in FORMATS)))).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    value = F.lit(None).cast("string")
    for k in FORMATS:
        value = F.when(F.col("kind") == k, shaped(k, seed, F.col("doc_id"), F.col("n"), F.col("try"))).otherwise(value)
    drawn = rows.select("kind", "n", "try", value.alias("value"))
    said = surfaces(F.col("value"), "n")
    fits = F.length(F.regexp_replace(said["cut"], "[^0-9]", "")) >= 4
    for v in (F.col("value"), *said.values()):
        fits &= invalid(F.col("kind"), v)
    first = drawn.groupBy("kind", "n").agg(F.min_by("value", F.when(fits, F.col("try"))).alias("value"))
    value = F.coalesce("value", F.raise_error(F.concat(F.lit("no valid probe of "), "kind")).cast("string"))
    head = F.concat(F.lit("value of "), F.col("kind"), F.lit(" is "))
    return first.withColumn("value", value).select("kind", "n", F.concat(head, "value", F.lit(".")).alias("text"), F.length(head).alias("start"), (F.length(head) + F.length("value")).alias("end"), "value")
