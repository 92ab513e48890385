"""Report tables over several decodings and layers, and the small picks and windows that reports take.

As in ``metrics``, statements are constants that Spark and DuckDB read alike. Each is one or two
aggregations over facts (a row a gold) or predictions, so it shuffles partial sums by few keys only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators import decoding, matching, taxonomy

#: Items that context tells.
CONTEXT_ITEMS = ("국문 성명", "주소", "영문 성명")

#: Whether a prediction meets any gold by the minimum overlap.
HITS = """
SELECT p.doc_id, p.pi, p.s, p.e, max(CASE WHEN c.ov >= least(c.glen, {k}) THEN 1 ELSE 0 END) AS hit
FROM {pred} p LEFT JOIN {cand} c ON c.doc_id = p.doc_id AND c.pi = p.pi GROUP BY p.doc_id, p.pi, p.s, p.e"""

#: Decodings side by side, a row each: ``facts`` and ``hits`` carry a column ``layer``.
DECODERS = """
SELECT f.layer, f.tp, f.fn, h.fp, h.n_pred, h.one_char, f.n_full, f.n_partial, f.n_none, f.exposed FROM (
  SELECT layer, cast(sum(matched) AS bigint) AS tp, cast(sum(1 - matched) AS bigint) AS fn, cast(sum(CASE WHEN covered = glen THEN 1 ELSE 0 END) AS bigint) AS n_full,
         cast(sum(CASE WHEN covered > 0 AND covered < glen THEN 1 ELSE 0 END) AS bigint) AS n_partial, cast(sum(CASE WHEN covered = 0 THEN 1 ELSE 0 END) AS bigint) AS n_none,
         cast(sum(CASE WHEN covered > 0 AND covered < glen THEN glen - covered ELSE 0 END) AS bigint) AS exposed FROM {facts} GROUP BY layer) f
JOIN (SELECT layer, count(*) AS n_pred, cast(sum(1 - hit) AS bigint) AS fp, cast(sum(CASE WHEN e - s = 1 THEN 1 ELSE 0 END) AS bigint) AS one_char FROM {hits} GROUP BY layer) h ON h.layer = f.layer"""

#: Unmatched predictions by the label of the first gold they touch; -1 where they touch none.
FP_OWNERS = """
SELECT coalesce(c.glabel, -1) AS owner, count(*) AS n, count(DISTINCT h.doc_id) AS docs FROM {hits} h
LEFT JOIN (SELECT doc_id, pi, glabel FROM (SELECT doc_id, pi, glabel, row_number() OVER (PARTITION BY doc_id, pi ORDER BY gi) AS rn FROM {cand}) x WHERE rn = 1) c ON c.doc_id = h.doc_id AND c.pi = h.pi
WHERE h.hit = 0 GROUP BY coalesce(c.glabel, -1)"""

#: States by layer and predictions that touch no gold, as four kinds of row.
LAYER_STATES = """
SELECT layer, kind, count(*) AS n FROM (
  SELECT layer, CASE WHEN covered = glen THEN 'full' WHEN covered > 0 THEN 'partial' ELSE 'none' END AS kind FROM {covers}
  UNION ALL SELECT layer, 'pure_fp' FROM {pure}) x GROUP BY layer, kind"""

#: A layer's boundaries on each gold: exact, partial or miss.
VERDICTS = """
SELECT label, count(*) AS n, cast(sum(CASE WHEN same = 1 THEN 1 ELSE 0 END) AS bigint) AS exact, cast(sum(CASE WHEN same = 0 AND any_ = 1 THEN 1 ELSE 0 END) AS bigint) AS partial, cast(sum(CASE WHEN any_ = 0 THEN 1 ELSE 0 END) AS bigint) AS miss
FROM (SELECT g.doc_id, g.gi, g.label, max(CASE WHEN c.exact THEN 1 ELSE 0 END) AS same, max(CASE WHEN c.pi IS NULL THEN 0 ELSE 1 END) AS any_
      FROM {gold} g LEFT JOIN {cand} c ON c.doc_id = g.doc_id AND c.gi = g.gi GROUP BY g.doc_id, g.gi, g.label) x GROUP BY label"""

#: Golds that only the later layer covers in full.
RESCUED = """
SELECT b.label, count(*) AS n, count(DISTINCT b.doc_id) AS docs FROM {before} b JOIN {after} a ON a.doc_id = b.doc_id AND a.gi = b.gi WHERE a.covered = a.glen AND b.covered < b.glen GROUP BY b.label"""

#: Mean over a label's tags (B, I, E, S) of the recall and precision of each that occurs.
MACRO = """
SELECT substr(tag, 3) AS label, avg(CASE WHEN n_gold > 0 THEN cast(n_right AS double) / n_gold END) AS macro_recall, avg(CASE WHEN n_pred > 0 THEN cast(n_right AS double) / n_pred END) AS macro_precision, count(*) AS parts
FROM {tags} WHERE tag <> 'O' GROUP BY substr(tag, 3)"""

#: Tokens in windows of fixed size that do not overlap.
TOKEN_WINDOWS = """
SELECT doc_id, cast(floor((ti - 1) / {size}) AS bigint) AS window_id, min(s) AS s, max(e) AS e, count(*) AS n FROM {tokens} GROUP BY doc_id, floor((ti - 1) / {size})"""

#: Labels of a document found both in full and not at all.
INCONSISTENT = """
SELECT doc_id, label, count(*) AS n, cast(sum(CASE WHEN covered = glen THEN 1 ELSE 0 END) AS bigint) AS n_full, cast(sum(CASE WHEN covered = 0 THEN 1 ELSE 0 END) AS bigint) AS n_none FROM {facts} GROUP BY doc_id, label
HAVING count(*) > 1 AND max(CASE WHEN covered = glen THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN covered = 0 THEN 1 ELSE 0 END) = 1"""


def decoders(docs: DataFrame, layers: dict[str, str]) -> DataFrame:
    """``DECODERS`` over a row a document: each document's counts of each layer, then their sums. A layer without golds or predictions has no row."""
    one = []
    for name, c in layers.items():
        facts = matching.facts_of(c)
        counts = {"tp": "f.matched = 1", "fn": "f.matched = 0", "n_full": "f.covered = f.glen", "n_partial": "f.covered > 0 AND f.covered < f.glen", "n_none": "f.covered = 0"}
        of = [f"'{n}', size(filter(facts_{c}, f -> {x}))" for n, x in counts.items()] + [f"'n_gold', size(facts_{c})", f"'n_pred', size({c})", f"'one_char', size(filter({c}, p -> p.e - p.s = 1))"]
        of += [f"'fp', size(filter({c}, p -> NOT coalesce({matching.hit_of()[0]}, false)))", f"'exposed', aggregate(facts_{c}, 0L, (a, f) -> a + if(f.covered > 0 AND f.covered < f.glen, f.glen - f.covered, 0))"]
        one.append((c, facts, f"named_struct('layer', '{name}', {', '.join(of)})"))
    docs = matching.met(docs, *layers.values())
    docs = docs.selectExpr("doc_id", "gold", *layers.values(), *(f"{facts} AS facts_{c}" for c, facts, _ in one)).selectExpr(f"inline(array({', '.join(x for *_, x in one)}))")
    names = ("tp", "fn", "fp", "n_pred", "one_char", "n_full", "n_partial", "n_none", "exposed")
    return docs.groupBy("layer").agg(*(F.sum(n).alias(n) for n in names), F.sum("n_gold").alias("n_gold")).filter("n_gold > 0 AND n_pred > 0").drop("n_gold")


def verdicts(docs: DataFrame) -> DataFrame:
    """``VERDICTS`` over a row a document."""
    same = "exists(x.pred, p -> p.s = x.g.s AND p.e = x.g.e)"
    g = matching.met(docs, "pred").selectExpr(f"inline_outer(transform(met, x -> named_struct('found', true, 'label', x.g.label, 'same', {same}, 'any_', size(x.pred) > 0)))").filter("found")
    count = lambda c: F.count_if(F.expr(c))
    return g.groupBy("label").agg(F.count("*").alias("n"), count("same").alias("exact"), count("NOT same AND any_").alias("partial"), count("NOT any_").alias("miss"))


def rescued(docs: DataFrame, before: str, after: str) -> DataFrame:
    """``RESCUED`` over a row a document; documents are counted where they lie."""
    won = matching.golds(docs, before, after).filter("covered2 = glen AND covered < glen").groupBy("label", "doc_id").agg(F.count("*").alias("n"))
    return won.groupBy("label").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


def examples(docs: DataFrame, n: int = 5, fixed: int = 3) -> DataFrame:
    """(bucket, stratum, doc_id, place, extra, rn): examples by document (as text) and place, ``n`` or ``fixed`` of each stratum.

    Golds that no prediction touches: A by item that context tells, B by unique identifier, E by probe type in documents
    without any rule span, F where a rule span has the gold's very bounds. Predictions: C cover a gold
    and ``extra`` characters beyond the longest they cover, D touch no gold. ``docs`` is a row a document as ``matching.beside``
    gives it, with ``rule`` spans, the golds' ``items`` in their order, and a ``probe_type``.
    """
    named = lambda items: ", ".join(map(repr, items))
    docs = matching.met(docs, "pred").selectExpr(
        "doc_id", "probe_type", "rule", "transform(filter(transform(met, (x, i) -> named_struct('x', x, 'item', items[i])), y -> size(y.x.pred) = 0), y -> named_struct('s', y.x.g.s, 'e', y.x.g.e, 'item', y.item)) AS missed",
        "transform(array_distinct(transform(pred, p -> named_struct('s', p.s, 'e', p.e))), p -> named_struct('s', p.s, 'extra', p.e - p.s - array_max(transform(filter(gold, g -> doc_id IS NOT NULL AND p.s <= g.s AND g.e <= p.e), g -> g.e - g.s)))) AS over",
        f"filter(pred, p -> NOT coalesce({matching.hit_of()[1]}, false)) AS pure",
    )
    pick = lambda spans, x, bucket, stratum, extra="0L": f"transform({spans}, {x} -> named_struct('bucket', '{bucket}', 'stratum', {stratum}, 'place', {x}.s, 'extra', {extra}))"
    pools = (
        pick(f"filter(missed, m -> m.item IN ({named(CONTEXT_ITEMS)}))", "m", "A", "m.item"), pick(f"filter(missed, m -> m.item IN ({named(taxonomy.RULE_ITEMS)}))", "m", "B", "m.item"), pick("filter(over, o -> o.extra > 0)", "o", "C", "''", "o.extra"), pick("pure", "p", "D", "''"),
        pick("if(size(rule) = 0 AND probe_type IS NOT NULL AND doc_id IS NOT NULL, missed, slice(missed, 1, 0))", "m", "E", "probe_type"), pick("filter(missed, m -> doc_id IS NOT NULL AND exists(rule, r -> r.s = m.s AND r.e = m.e))", "m", "F", "''"),
    )
    pool = docs.selectExpr("doc_id", f"inline_outer(concat({', '.join(pools)}))").filter("bucket IS NOT NULL")
    ranked = pool.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "stratum").orderBy(F.col("doc_id").cast("string"), "place", "extra"))).filter(F.col("rn") <= max(n, fixed))  # by a number, so that each task keeps its first only
    return ranked.filter(F.col("rn") <= F.when(F.col("bucket").isin("B", "E"), fixed).otherwise(n)).select("bucket", "stratum", "doc_id", "place", "extra", F.col("rn").cast("long").alias("rn"))


#: Values by kind whose check digits hold although they must not.
CHECK_AUDIT = """SELECT kind, count(*) AS n, cast(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS bigint) AS still_valid FROM {checked} GROUP BY kind"""


def transition_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(tag, n_next, next) of every tag class: which may follow it, in class order. As many rows as classes."""
    tags = decoding.classes(labels)
    legal = decoding.transitions(tags)[0]
    rows = [(t, int(legal[i].sum()), ",".join(x for j, x in enumerate(tags) if legal[i, j])) for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "tag string, n_next long, next string")


def _last(side: DataFrame, name: str) -> DataFrame:
    newest = Window.partitionBy("text").orderBy(F.desc("ord"))
    return side.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").select(F.col("text").alias(f"_{name}"), F.col("spans").alias(f"{name}_spans"))


def three_way(gold: DataFrame, model: DataFrame, rule: DataFrame) -> DataFrame:
    """Gold documents with the spans of two layers by equal text, the last of repeated ones; ``model_missing`` and
    ``rule_missing`` tell where a side has no such text. ``model`` and ``rule``: ord, text, spans."""
    out = gold
    for name, side in (("model", model), ("rule", rule)):
        out = out.join(_last(side, name), out["text"] == F.col(f"_{name}"), "left").withColumn(f"{name}_missing", F.col(f"_{name}").isNull()).drop(f"_{name}")
    return out


def without_text(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The join on ids for predictions that carry no text: the last of a repeated id, null spans where there is none."""
    newest = Window.partitionBy("id").orderBy(F.desc("ord"))
    last = pred.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").select(F.col("id").alias("_id"), F.col("spans").alias("pred_spans"))
    return gold.join(last, gold["id"] == F.col("_id"), "left").drop("_id")
