"""The whole evaluation as one plan: documents and predictions in, one long table of metrics out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge import functions as fn
from spanforge.operators import matching, metrics, summaries
from spanforge.sources import readers


def span_frames(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold spans (category as label) and predicted spans, document by document joined on the text (the id if no prediction has one).

    ``gold``: as ``read_gold`` gives it; ``pred``: ord, id, text, spans. Predictions outside the text are dropped.
    """
    joined = readers.by_text(gold, pred).withColumn("_doc", F.col("ord").cast("long"))
    g = joined.select(F.col("_doc").alias("doc_id"), F.posexplode("spans").alias("gi", "x"))
    p = joined.select(F.col("_doc").alias("doc_id"), "text", F.posexplode("pred_spans").alias("pi", "x")).filter(fn.valid_span("x.start", "x.end", "text"))
    columns = lambda d, i, label: d.select("doc_id", F.col(i).cast("long").alias(i), F.col("x.start").cast("long").alias("s"), F.col("x.end").cast("long").alias("e"), label.alias("label"))
    return columns(g, "gi", F.coalesce("x.corp_category", F.lit("(미분류)"))), columns(p, "pi", F.coalesce("x.label", F.lit("(무라벨)")))


def scores(gold: DataFrame, pred: DataFrame, k: int = 3) -> DataFrame:
    """(key, value) over span frames: counts and rates over all and by label, states, exposed characters, documents with a miss.

    A gold is matched by ``k`` shared characters (all of a shorter one); several golds may share a prediction.
    Without any gold only the keys of predictions are there.
    """
    cand = matching.candidates(gold, pred)
    cover = matching.coverage(gold, pred).select("doc_id", "gi", "label", "glen", "covered")
    facts = cover.join(matching.threshold(gold, cand, k).select("doc_id", "gi", "matched"), ["doc_id", "gi"])
    full, part = F.col("covered") == F.col("glen"), (F.col("covered") > 0) & (F.col("covered") < F.col("glen"))
    counts = {
        "gold": F.count("*"), "tp": F.sum("matched"), "fn": F.sum(1 - F.col("matched")), "full": F.count_if(full), "partial": F.count_if(part), "none": F.count_if(F.col("covered") == 0),
        "exposed_chars": F.sum(F.when(part, F.col("glen") - F.col("covered")).otherwise(0)), "missed_docs": F.count_distinct(F.when(F.col("matched") == 0, F.col("doc_id"))),
    }
    by = facts.rollup("label").agg(F.grouping("label").alias("_all"), *(F.coalesce(c, F.lit(0)).cast("double").alias(n) for n, c in counts.items()))
    name = F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.concat(F.lit("label."), F.col("label")))
    rates = {"recall": fn.ratio("tp", "gold")}
    by = by.select(name.alias("name"), *counts, *(c.cast("double").alias(n) for n, c in rates.items()))
    every = [*counts, *rates]
    long = by.select(F.explode(F.arrays_zip(F.array(*(F.concat("name", F.lit(f".{n}")) for n in every)).alias("key"), F.array(*every).alias("value"))).alias("x")).select("x.key", "x.value")
    hits = metrics.run(summaries.HITS, gold, pred=pred, cand=cand, k=k)
    side = hits.agg(F.count("*").cast("double").alias("pred"), F.coalesce(F.sum(1 - F.col("hit")), F.lit(0)).cast("double").alias("fp"))
    precision = fn.ratio(F.col("pred") - F.col("fp"), "pred").cast("double")
    of_pred = side.select(F.explode(F.create_map(F.lit("overall.pred"), F.col("pred"), F.lit("overall.fp"), F.col("fp"), F.lit("overall.precision"), precision)).alias("key", "value"))
    return long.unionByName(of_pred)


def broken(values: dict[str, float]) -> list[str]:
    """Which invariants a table of metrics breaks: matches and states add up to the golds, rates lie within 0 and 1."""
    out = []
    for name in {k.rsplit(".", 1)[0] for k in values if k.endswith(".gold")}:
        v = lambda k: values[f"{name}.{k}"]  # noqa: E731, B023
        if v("tp") + v("fn") != v("gold"):
            out.append(f"{name}: matched and missed")
        if v("full") + v("partial") + v("none") != v("gold"):
            out.append(f"{name}: states")
    if values["overall.fp"] > values["overall.pred"]:
        out.append("overall: false positives")
    return sorted(out + [k for k, v in values.items() if k.endswith((".recall", ".precision")) and not 0 <= v <= 1])


def recall_fractions(rates: DataFrame, supports: DataFrame) -> DataFrame:
    """(label, fraction) from rounded recalls ``rates(label, rate)`` and ``supports(label, support)``: ``n/d``, with ``~`` where the
    count is more than 0.05 from whole; four decimals where the support is unknown, ``n/a`` where the rate is."""
    exact = F.col("rate") * F.col("support")
    n = F.bround(exact)
    mark = F.when(F.abs(exact - n) > 0.05, "~").otherwise("")
    known = F.concat(mark, n.cast("long").cast("string"), F.lit("/"), F.col("support").cast("string"))
    out = F.when(F.col("rate").isNull(), "n/a").when(F.col("support").isNull(), F.format_string("%.4f", "rate")).otherwise(known)
    return rates.join(supports, "label", "left").select("label", out.alias("fraction"))


def showcase(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, gold, first, second: span arrays) for people to compare: both maskings, and the ranges that the first leaks and overruns."""
    return docs.select(
        "doc_id", F.col("text").alias("source_text"), fn.masked("text", "first").alias("masked_first"), fn.masked("text", "second").alias("masked_second"),
        F.col("gold").alias("gold_spans"), F.col("first").alias("pred_spans"), fn.uncovered("gold", "first").alias("leaked_spans"), fn.uncovered("first", "gold").alias("overrun_spans"),
    )
