"""Matching and coverage of gold and predicted spans.

Inputs: ``gold(doc_id, gi, s, e, label)`` and ``pred(doc_id, pi, s, e, label)``, half-open intervals.
Every operator is declarative SQL over DataFrames: an equi-join on the document with the interval
condition as residual, windows, or an array fold per document where the result depends on order.
The four matching semantics (containment, greedy one-to-one, minimum overlap, coverage) are separate.
The statements that both Spark and DuckDB read alike are constants, so that tests can run them there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Every overlapping pair once, with all that the matching rules need.
CANDIDATES = """
SELECT g.doc_id, g.gi, p.pi, g.s AS gs, g.e AS ge, g.label AS glabel, p.s AS ps, p.e AS pe, p.label AS plabel,
       least(g.e, p.e) - greatest(g.s, p.s) AS ov, g.e - g.s AS glen, (g.label = p.label) AS same_label, (g.s = p.s AND g.e = p.e) AS exact
FROM {gold} g JOIN {pred} p ON g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e"""

#: Gold inside a prediction counts for recall, prediction inside gold for precision.
CONTAINMENT = """
SELECT (SELECT count(*) FROM {gold}) AS n_gold, (SELECT count(*) FROM {pred}) AS n_pred,
       (SELECT count(*) FROM {gold} g WHERE EXISTS (SELECT 1 FROM {pred} p WHERE p.doc_id = g.doc_id AND p.s <= g.s AND g.e <= p.e)) AS recall_tp,
       (SELECT count(*) FROM {pred} p WHERE EXISTS (SELECT 1 FROM {gold} g WHERE p.doc_id = g.doc_id AND g.s <= p.s AND p.e <= g.e)) AS precision_tp,
       (SELECT count(*) FROM {gold} g WHERE EXISTS (SELECT 1 FROM {pred} p WHERE p.doc_id = g.doc_id AND p.label = g.label AND p.s <= g.s AND g.e <= p.e)) AS typed_recall_tp,
       (SELECT count(*) FROM {pred} p WHERE EXISTS (SELECT 1 FROM {gold} g WHERE p.doc_id = g.doc_id AND p.label = g.label AND g.s <= p.s AND p.e <= g.e)) AS typed_precision_tp"""

#: Label-blind, many-to-one: a gold matches by k shared characters, or all of it if it is shorter.
THRESHOLD = """
SELECT g.doc_id, g.gi, max(CASE WHEN c.ov >= least(c.glen, {k}) THEN 1 ELSE 0 END) AS matched, max(CASE WHEN c.ov >= 1 THEN 1 ELSE 0 END) AS touched
FROM {gold} g LEFT JOIN {cand} c ON c.doc_id = g.doc_id AND c.gi = g.gi GROUP BY g.doc_id, g.gi"""

THRESHOLD_SUMMARY = """
SELECT cast(sum(coalesce(m.matched, 0)) AS bigint) AS tp, cast(sum(1 - coalesce(m.matched, 0)) AS bigint) AS fn,
       cast(sum(CASE WHEN m.touched = 1 AND m.matched = 0 THEN 1 ELSE 0 END) AS bigint) AS dropped_by_threshold,
       (SELECT count(*) FROM {pred} p WHERE NOT EXISTS (SELECT 1 FROM {cand} c WHERE c.doc_id = p.doc_id AND c.pi = p.pi AND c.ov >= least(c.glen, {k}))) AS fp,
       (SELECT count(*) FROM {pred} p WHERE NOT EXISTS (SELECT 1 FROM {cand} c WHERE c.doc_id = p.doc_id AND c.pi = p.pi)) AS pure_fp
FROM {matched} m"""

#: Largest overlap; ties by earlier start, then lower index.
REPRESENTATIVE = """
SELECT doc_id, gi, pi, ov FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gi ORDER BY ov DESC, ps, pi) AS rn FROM {cand}) x WHERE rn = 1"""

#: The union of a document's spans as islands; ``{op}`` is ``>`` to merge touching ones, ``>=`` to keep them apart.
ISLANDS = """
SELECT doc_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e, label ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN before IS NULL OR s {op} before THEN 1 ELSE 0 END AS fresh FROM (
      SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT doc_id, s, e, label FROM {spans}) a) b) c) d
GROUP BY doc_id, island"""

#: Characters of each gold that any prediction covers, and its state.
COVERAGE = """
SELECT g.doc_id, g.gi, g.label, g.e - g.s AS glen, cast(sum(CASE WHEN u.s IS NULL THEN 0 ELSE least(g.e, u.e) - greatest(g.s, u.s) END) AS bigint) AS covered
FROM {gold} g LEFT JOIN {islands} u ON u.doc_id = g.doc_id AND g.s < u.e AND u.s < g.e GROUP BY g.doc_id, g.gi, g.label, g.s, g.e"""

STATES = """
SELECT CASE WHEN covered = glen THEN 'full' WHEN covered > 0 THEN 'partial' ELSE 'none' END AS state, count(*) AS n,
       cast(sum(CASE WHEN covered > 0 AND covered < glen THEN glen - covered ELSE 0 END) AS bigint) AS exposed_chars
FROM {coverage} c GROUP BY 1"""

#: Covered in full by the union though by no single prediction.
SPLIT_COVER = """
SELECT c.doc_id, c.gi FROM {coverage} c JOIN {gold} g ON g.doc_id = c.doc_id AND g.gi = c.gi
WHERE c.covered = c.glen AND NOT EXISTS (SELECT 1 FROM {pred} p WHERE p.doc_id = g.doc_id AND p.s <= g.s AND g.e <= p.e)"""

#: Ranges of ``a`` that no span of ``b`` covers; both are islands (disjoint).
DIFFERENCE = """
SELECT doc_id, s, e FROM (
  SELECT a.doc_id, CASE WHEN b.s IS NULL OR b.s <= a.s THEN NULL ELSE a.s END AS s, b.s AS e FROM {a} a
    JOIN (SELECT a2.doc_id AS d, a2.s AS s0, min(b2.s) AS s FROM {a} a2 JOIN {b} b2 ON b2.doc_id = a2.doc_id AND a2.s < b2.e AND b2.s < a2.e GROUP BY a2.doc_id, a2.s) b ON b.d = a.doc_id AND b.s0 = a.s
  UNION ALL
  SELECT a.doc_id, b.e AS s, least(a.e, coalesce(b.nx, a.e)) AS e FROM {a} a
    JOIN (SELECT doc_id, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nx FROM {b}) b ON b.doc_id = a.doc_id AND a.s < b.e AND b.s < a.e
  UNION ALL
  SELECT a.doc_id, a.s, a.e FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE b.doc_id = a.doc_id AND a.s < b.e AND b.s < a.e)) x
WHERE s IS NOT NULL AND s < e"""

#: Characters masked beyond gold, of each prediction: those that no earlier one has claimed.
OVERMASK = """
SELECT p.doc_id, p.pi, p.label, greatest(0, p.e - greatest(p.s, coalesce(p.claimed, 0)))
       - cast(sum(CASE WHEN u.s IS NULL THEN 0 ELSE greatest(0, least(p.e, u.e) - greatest(p.s, u.s, coalesce(p.claimed, 0))) END) AS bigint) AS over_chars
FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, label, pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS claimed FROM {pred}) p
LEFT JOIN {islands} u ON u.doc_id = p.doc_id AND p.s < u.e AND u.s < p.e GROUP BY p.doc_id, p.pi, p.label, p.s, p.e, p.claimed"""

#: The gold that a prediction belongs to: one that contains it (first), else the largest overlap (first), else none.
ATTRIBUTION = """
SELECT p.doc_id, p.pi, coalesce(cast(c.gi AS bigint), -1) AS gi, coalesce(c.glabel, -1) AS owner
FROM {pred} p LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pi ORDER BY CASE WHEN gs <= ps AND pe <= ge THEN 0 ELSE 1 END, CASE WHEN gs <= ps AND pe <= ge THEN 0 ELSE -ov END, gi) AS rn FROM {cand}) c
ON c.doc_id = p.doc_id AND c.pi = p.pi AND c.rn = 1"""

#: Characters labelled alike (in both or in neither) against all of a text of ``total`` characters.
CHAR_ACCURACY = """
SELECT t.doc_id, t.total - coalesce(a.n, 0) - coalesce(b.n, 0) + 2 * coalesce(c.n, 0) AS alike, t.total FROM {totals} t
LEFT JOIN (SELECT doc_id, sum(e - s) AS n FROM {a} GROUP BY doc_id) a ON a.doc_id = t.doc_id
LEFT JOIN (SELECT doc_id, sum(e - s) AS n FROM {b} GROUP BY doc_id) b ON b.doc_id = t.doc_id
LEFT JOIN (SELECT a.doc_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS n FROM {a} a JOIN {b} b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e GROUP BY a.doc_id) c ON c.doc_id = t.doc_id"""

#: Per label: characters of gold, and those covered.
LABEL_CHAR_RECALL = """
SELECT label, cast(sum(covered) AS bigint) AS covered, cast(sum(glen) AS bigint) AS total FROM {coverage} c GROUP BY label"""

#: Runs of consecutive numbers as ranges.
RANGES = """
SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT DISTINCT doc_id, i FROM {points}) a) b GROUP BY doc_id, run"""



def _sql(template: str, df: DataFrame, **args) -> DataFrame:
    return df.sparkSession.sql(template, **args)


def beside(gold: DataFrame, **preds: DataFrame) -> DataFrame:
    """(doc_id, gold and each of ``preds``): a row a document with its golds and its predictions, in no order. What is local to a document
    needs no join from here on, and no other shuffle by the document."""
    span = lambda names: "named_struct(" + ", ".join(f"'{n}', cast({n} AS bigint)" if n != "label" else "'label', label" for n in names) + ")"
    sides = {"gold": (gold, ("gi", "s", "e", "label"))} | {n: (p, ("s", "e", "label", "pi") if "pi" in p.columns else ("s", "e", "label")) for n, p in preds.items()}
    own = " UNION ALL ".join(f"SELECT doc_id, {', '.join(span(names) if m == n else 'null' for m in sides)} FROM {{{n}}}" for n, (_, names) in sides.items())
    listed = ", ".join(f"collect_list({n}_) OVER (PARTITION BY doc_id) AS {n}" for n in sides)
    return _sql(f"SELECT doc_id, {', '.join(sides)} FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS rn, {listed} FROM ({own}) u(doc_id, {', '.join(f'{n}_' for n in sides)})) x WHERE rn = 1", gold, **{n: d for n, (d, _) in sides.items()})


#: Of an element x, a gold x.g with the predictions x.near that it meets, by place: what the unions and pairs of the statements above say.
COVERED_OF = """aggregate(x.{near}, named_struct('at', x.g.s, 'n', 0L), (a, p) -> if(p.e > a.at, named_struct('at', least(p.e, x.g.e), 'n', a.n + least(p.e, x.g.e) - greatest(p.s, a.at)), a), a -> a.n)"""
SHARES_OF = "exists(x.{near}, p -> least(p.e, x.g.e) - greatest(p.s, x.g.s) >= {least})"
NEAREST_OF = "array_min(transform(x.{near}, p -> named_struct('k', greatest(p.s, x.g.s) - least(p.e, x.g.e), 's', p.s, 'pi', p.pi, 'e', p.e, 'label', p.label)))"


def met(docs: DataFrame, *preds: str) -> DataFrame:
    """``docs`` with ``met``: each gold ``g`` and, under the name of each column of predictions, those of them that it meets, by place."""
    near = ", ".join(f"'{n}', sort_array(filter({n}, p -> doc_id IS NOT NULL AND p.s < g.e AND g.s < p.e))" for n in preds)
    return _sql(f"SELECT *, transform(gold, g -> named_struct('g', g, {near})) AS met FROM {{docs}}", docs, docs=docs)


def facts_of(*preds: str, k: int = 3, more: str = "") -> str:
    """An array expression over ``met``: gi, s, e, label, glen and, for each column of predictions, covered, matched, touched (with a 2 behind for the second)."""
    of = lambda n, i: f", 'covered{i}', {COVERED_OF}, 'matched{i}', if({SHARES_OF.replace('{least}', f'least(x.g.e - x.g.s, {int(k)})')}, 1, 0), 'touched{i}', if({SHARES_OF.replace('{least}', '1')}, 1, 0)".replace("{near}", n)
    return f"transform(met, x -> named_struct('gi', x.g.gi, 's', x.g.s, 'e', x.g.e, 'label', x.g.label, 'glen', x.g.e - x.g.s{''.join(of(n, i) for n, i in zip(preds, ('', 2)))}{more}))"


def golds(docs: DataFrame, *preds: str, k: int = 3, more: str = "") -> DataFrame:
    """``facts_of`` as rows with their doc_id. The outer explode has its array built once; a plain one has it built again, for a filter before it."""
    facts = met(docs, *preds).selectExpr("doc_id", f"explode_outer({facts_of(*preds, k=k, more=more)}) AS f")
    return facts.filter("f IS NOT NULL").select("doc_id", "f.*")


def candidates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(CANDIDATES, gold, gold=gold, pred=pred)


def containment(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(CONTAINMENT, gold, gold=gold, pred=pred)


#: Candidates with the number of their cluster: no candidate reaches from one cluster into the next.
CLUSTERS = """
SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lo, hi, gi, pi ROWS UNBOUNDED PRECEDING) AS cluster FROM (
  SELECT *, CASE WHEN lo < max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, gi, pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
    SELECT *, least(gs, ps) AS lo, greatest(ge, pe) AS hi FROM {cand} WHERE {keep}) a) b"""


def greedy(cand: DataFrame, criterion: str = "type") -> DataFrame:
    """(doc_id, gi, pi) matched one-to-one by overlap, largest first; ties by starts, then indexes.

    ``strict`` takes equal offsets of one label, ``partial`` any overlap of one label, ``type`` any overlap.
    Candidates that share no character share no span, so the fold runs over one cluster of candidates at a
    time and a long document needs no array of all its candidates.
    """
    keep = {"strict": "exact AND same_label", "partial": "same_label", "type": "true"}[criterion]
    fold = """aggregate(array_sort(collect_list(named_struct('k', -ov, 'gs', gs, 'ps', ps, 'gi', gi, 'pi', pi))),
        named_struct('g', cast(array() AS array<bigint>), 'p', cast(array() AS array<bigint>)),
        (a, x) -> if(array_contains(a.g, cast(x.gi AS bigint)) OR array_contains(a.p, cast(x.pi AS bigint)), a,
                     named_struct('g', array_append(a.g, cast(x.gi AS bigint)), 'p', array_append(a.p, cast(x.pi AS bigint)))))"""
    return _sql(f"SELECT doc_id, z.g AS gi, z.p AS pi FROM (SELECT doc_id, inline(arrays_zip(m.g, m.p)) AS (g, p) FROM (SELECT doc_id, {fold} AS m FROM ({CLUSTERS.replace('{keep}', keep)}) c GROUP BY doc_id, cluster) y) z", cand, cand=cand)


#: The same for DuckDB: the fold as a recursive walk over ranks.
GREEDY_WALK = """
r AS (SELECT doc_id, gi, pi, row_number() OVER (PARTITION BY doc_id ORDER BY -ov, gs, ps, gi, pi) AS k FROM cand WHERE {keep}),
w AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS g, []::BIGINT[] AS p FROM (SELECT DISTINCT doc_id FROM r) UNION ALL
      SELECT w.doc_id, r.k, CASE WHEN list_contains(w.g, r.gi) OR list_contains(w.p, r.pi) THEN w.g ELSE list_append(w.g, r.gi) END,
             CASE WHEN list_contains(w.g, r.gi) OR list_contains(w.p, r.pi) THEN w.p ELSE list_append(w.p, r.pi) END
      FROM w JOIN r ON r.doc_id = w.doc_id AND r.k = w.k + 1),
z AS (SELECT doc_id, arg_max(g, k) AS g, arg_max(p, k) AS p FROM w GROUP BY doc_id)
SELECT doc_id, unnest(g) AS gi, unnest(p) AS pi FROM z"""


def threshold(gold: DataFrame, cand: DataFrame, k: int = 3) -> DataFrame:
    return _sql(THRESHOLD.replace("{k}", str(int(k))), gold, gold=gold, cand=cand)


def threshold_summary(gold: DataFrame, pred: DataFrame, k: int = 3) -> DataFrame:
    cand = candidates(gold, pred)
    return _sql(THRESHOLD_SUMMARY.replace("{k}", str(int(k))), gold, pred=pred, cand=cand, matched=threshold(gold, cand, k))


def hit_of(k: int = 3, pred: str = "pred") -> tuple[str, str]:
    """Of a prediction p, over a row of ``beside``: whether it meets a gold by the minimum overlap, and whether it meets any."""
    meets = "doc_id IS NOT NULL AND g.s < p.e AND p.s < g.e"
    return f"exists(gold, g -> {meets} AND least(g.e, p.e) - greatest(g.s, p.s) >= least(g.e - g.s, {int(k)}))", f"exists(gold, g -> {meets})"


def threshold_summary_of(docs: DataFrame, k: int = 3) -> DataFrame:
    """``THRESHOLD_SUMMARY`` over a row a document: counts by document first, then their sums."""
    hit, meets = hit_of(k)
    docs = met(docs, "pred").selectExpr(f"{facts_of('pred', k=k)} AS facts", f"transform(pred, p -> named_struct('hit', {hit}, 'meets', {meets})) AS preds")
    n = {"tp": "filter(facts, f -> f.matched = 1)", "fn": "filter(facts, f -> f.matched = 0)", "dropped_by_threshold": "filter(facts, f -> f.touched = 1 AND f.matched = 0)", "fp": "filter(preds, p -> NOT coalesce(p.hit, false))", "pure_fp": "filter(preds, p -> NOT coalesce(p.meets, false))"}
    return docs.selectExpr(*(f"size({x}) AS {c}" for c, x in n.items())).selectExpr(*(f"sum({c}) AS {c}" if c in ("tp", "fn", "dropped_by_threshold") else f"coalesce(sum({c}), 0) AS {c}" for c in n))


def representative(cand: DataFrame) -> DataFrame:
    return _sql(REPRESENTATIVE, cand, cand=cand)


def islands(spans: DataFrame, touching: bool = True) -> DataFrame:
    return _sql(ISLANDS.replace("{op}", ">" if touching else ">="), spans, spans=spans)


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(COVERAGE, gold, gold=gold, islands=islands(pred))


def states(cover: DataFrame) -> DataFrame:
    return _sql(STATES, cover, coverage=cover)


def split_cover(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(SPLIT_COVER, gold, gold=gold, pred=pred, coverage=coverage(gold, pred))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ranges of islands ``a`` outside islands ``b``: leaks (gold, pred) or overruns (pred, gold)."""
    return _sql(DIFFERENCE, a, a=a, b=b)


def _union_of(spans: str) -> str:
    """The islands of a column of spans, touching ones merged, in order: the open one and those closed are kept apart, so that each is added once."""
    step = "if(y.s <= a.e, named_struct('s', a.s, 'e', greatest(a.e, y.e), 'out', a.out), named_struct('s', y.s, 'e', y.e, 'out', if(a.s IS NULL, a.out, array_append(a.out, named_struct('s', a.s, 'e', a.e)))))"
    zero = "named_struct('s', cast(null AS bigint), 'e', cast(null AS bigint), 'out', cast(array() AS array<struct<s: bigint, e: bigint>>))"
    return f"aggregate(sort_array(transform({spans}, y -> named_struct('s', y.s, 'e', y.e))), {zero}, (a, y) -> {step}, a -> if(a.s IS NULL, a.out, array_append(a.out, named_struct('s', a.s, 'e', a.e))))"


def outside(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``difference`` of the islands of two columns of a row a document: what is left of each island between those that it meets."""
    docs = docs.selectExpr("doc_id", f"{_union_of(a)} AS a", f"{_union_of(b)} AS b")
    docs = docs.selectExpr("doc_id", "transform(a, x -> named_struct('x', x, 'near', filter(b, y -> size(b) > 0 AND doc_id IS NOT NULL AND x.s < y.e AND y.s < x.e))) AS m")
    cut = """flatten(transform(m, z -> transform(sequence(0, size(z.near)), i -> named_struct('s', if(i = 0, z.x.s, get(z.near, i - 1).e), 'e', if(i = size(z.near), z.x.e, get(z.near, i).s)))))"""
    return docs.selectExpr("doc_id", f"inline_outer({cut}) AS (s, e)").filter("s < e")


def overmask(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(OVERMASK, gold, pred=pred, islands=islands(gold))


def attribution(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(ATTRIBUTION, gold, pred=pred, cand=candidates(gold, pred))


def char_accuracy(totals: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _sql(CHAR_ACCURACY, gold, totals=totals, a=islands(gold), b=islands(pred))


def label_char_recall(cover: DataFrame) -> DataFrame:
    return _sql(LABEL_CHAR_RECALL, cover, coverage=cover)


def ranges(points: DataFrame) -> DataFrame:
    return _sql(RANGES, points, points=points)


def matched_golds(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Semi-join: golds that a prediction contains. Its anti-join gives the missed."""
    g, p = gold.alias("g"), pred.alias("p")
    from pyspark.sql import functions as F

    return g.join(p, (F.col("g.doc_id") == F.col("p.doc_id")) & (F.col("p.s") <= F.col("g.s")) & (F.col("g.e") <= F.col("p.e")), "left_semi")
