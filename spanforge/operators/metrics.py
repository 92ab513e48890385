"""Aggregations over matched spans: scores, buckets, documents, layers, crosstabs, token metrics.

Statements that Spark and DuckDB read alike are constants; functions run them over DataFrames.
``facts`` is one row a gold span: doc_id, gi, label, glen, matched, covered and what a query adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import matching, rules

#: Scores of a (criterion, tp, n_gold, n_pred) row.
SCORES = """
SELECT criterion, tp, n_gold - tp AS fn, n_pred - tp AS fp,
       CASE WHEN n_pred > 0 THEN cast(tp AS double) / n_pred ELSE 0.0 END AS precision, CASE WHEN n_gold > 0 THEN cast(tp AS double) / n_gold ELSE 0.0 END AS recall,
       CASE WHEN n_gold + n_pred > 0 THEN cast(2 * tp AS double) / (n_gold + n_pred) ELSE 0.0 END AS f1, CASE WHEN 4 * n_gold + n_pred > 0 THEN cast(5 * tp AS double) / (4 * n_gold + n_pred) ELSE 0.0 END AS f2
FROM {counts}"""

#: Precision and recall from different numbers of matches; F only where both are defined and not both 0.
SPLIT_SCORES = """
SELECT *, CASE WHEN p IS NOT NULL AND r IS NOT NULL AND p + r > 0 THEN 2 * p * r / (p + r) END AS f1, CASE WHEN p IS NOT NULL AND r IS NOT NULL AND p + r > 0 THEN 5 * p * r / (4 * p + r) END AS f2
FROM (SELECT CASE WHEN n_pred > 0 THEN cast(precision_tp AS double) / n_pred END AS p, CASE WHEN n_gold > 0 THEN cast(recall_tp AS double) / n_gold END AS r FROM {counts}) x"""

#: One span counts in its total, label, length tier and each of its cases at once.
BUCKETS = """
SELECT dim, key, count(*) AS n, cast(sum(matched) AS bigint) AS tp, cast(sum(1 - matched) AS bigint) AS fn, cast(sum(CASE WHEN covered = glen THEN 1 ELSE 0 END) AS bigint) AS n_full,
       cast(sum(CASE WHEN covered > 0 AND covered < glen THEN 1 ELSE 0 END) AS bigint) AS n_partial, cast(sum(CASE WHEN covered > 0 AND covered < glen THEN glen - covered ELSE 0 END) AS bigint) AS exposed
FROM (
  SELECT 'all' AS dim, 'all' AS key, matched, covered, glen FROM {facts}
  UNION ALL SELECT 'label', cast(label AS varchar(20)), matched, covered, glen FROM {facts}
  UNION ALL SELECT 'tier', tier, matched, covered, glen FROM {facts}
  UNION ALL SELECT 'case', 'even', matched, covered, glen FROM {facts} WHERE gi % 2 = 0
  UNION ALL SELECT 'case', 'third', matched, covered, glen FROM {facts} WHERE gi % 3 = 0) x GROUP BY dim, key"""

#: Tier limits are exact order statistics: the values at n/3 and 2n/3 of the sorted lengths.
TERCILES = """
SELECT min(CASE WHEN upto > n3 THEN glen END) AS q1, min(CASE WHEN upto > n6 THEN glen END) AS q2
FROM (SELECT glen, upto, cast(floor(total / 3) AS bigint) AS n3, cast(floor(2 * total / 3) AS bigint) AS n6
      FROM (SELECT glen, cast(sum(n) OVER (ORDER BY glen) AS bigint) AS upto, cast(sum(n) OVER () AS bigint) AS total FROM (SELECT glen, count(*) AS n FROM {facts} GROUP BY glen) a) b) c"""

DOC_MISS = """
SELECT label, count(*) AS n_gold, cast(sum(1 - matched) AS bigint) AS missed, count(DISTINCT CASE WHEN matched = 0 THEN doc_id END) AS docs_missed, count(DISTINCT doc_id) AS docs FROM {facts} GROUP BY label"""

#: The most sensitive missed label of each document: least rank, then least label.
TOP_MISS = """
SELECT doc_id, label, sens FROM (SELECT doc_id, label, sens, row_number() OVER (PARTITION BY doc_id ORDER BY sens, label) AS rn FROM (SELECT DISTINCT doc_id, label, (label * 5) % 7 AS sens FROM {facts} WHERE matched = 0) a) b WHERE rn = 1"""

def fp_buckets(gold: DataFrame, pred: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, kind, n, docs) of the predictions that no gold contains, by what they cover in the text.

    B2: an order number or stock code in the surface, whatever it touches; else B3: gold is touched
    short of containing; else B1, with a hint of what the surface may be.
    """
    touched = matching.candidates(gold, pred).groupBy("doc_id", "pi").agg(F.max((F.col("gs") <= F.col("ps")) & (F.col("pe") <= F.col("ge"))).alias("inside"))
    wrong = pred.join(touched, ["doc_id", "pi"], "left").filter("NOT coalesce(inside, false)").join(texts, "doc_id")
    look = rules.surface_kind(F.expr("substring(text, cast(s AS int) + 1, cast(e - s AS int))"))
    named = wrong.select("doc_id", F.col("inside").isNotNull().alias("touches"), look.alias("look"))
    hard = F.col("look").isin("order", "stock_code")
    bucket = F.when(hard, "B2").when(F.col("touches"), "B3").otherwise("B1")
    kind = F.when(~hard & F.col("touches"), "boundary").otherwise(F.col("look"))
    return named.groupBy(bucket.alias("bucket"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


#: Layers side by side: golds found, missed, documents missed.
LAYERS = """
SELECT layer, label, count(*) AS n_gold, cast(sum(CASE WHEN covered = glen THEN 1 ELSE 0 END) AS bigint) AS tp, cast(sum(CASE WHEN covered < glen THEN 1 ELSE 0 END) AS bigint) AS missed, count(DISTINCT CASE WHEN covered < glen THEN doc_id END) AS docs_missed
FROM {covers} GROUP BY layer, label"""

#: How states of one layer turn into those of another.
CROSSTAB = """
SELECT before, cast(sum(CASE WHEN after = 'full' THEN 1 ELSE 0 END) AS bigint) AS n_full, cast(sum(CASE WHEN after = 'partial' THEN 1 ELSE 0 END) AS bigint) AS n_partial, cast(sum(CASE WHEN after = 'none' THEN 1 ELSE 0 END) AS bigint) AS n_none, count(*) AS n_all
FROM (SELECT CASE WHEN a.covered = a.glen THEN 'full' WHEN a.covered > 0 THEN 'partial' ELSE 'none' END AS before, CASE WHEN b.covered = b.glen THEN 'full' WHEN b.covered > 0 THEN 'partial' ELSE 'none' END AS after
      FROM {a} a JOIN {b} b ON a.doc_id = b.doc_id AND a.gi = b.gi) x GROUP BY before"""

def histogram(values: DataFrame) -> DataFrame:
    """(bin, n, percent, least, upper_median, most, mean) of whole numbers ``v``: counts of 1, 2, 3 to 5, 6 and more, empty bins
    too, and one row ``all`` with the figures over all values. An empty input gives four empty bins and no figures.

    Equal values meet first, so that the median is found among distinct ones.
    """
    counts = values.groupBy("v").agg(F.count("*").alias("k"))
    upto = counts.select("v", "k", F.sum("k").over(Window.orderBy("v")).alias("upto"))  # one row for each distinct value
    total = counts.agg(F.sum("k").alias("total"))
    label = F.when(F.col("v") == 1, "1").when(F.col("v") == 2, "2").when(F.col("v").between(3, 5), "3-5").when(F.col("v") >= 6, "6+")
    share = (F.coalesce("n", F.lit(0)) * 100 / F.col("total")).alias("percent")
    no = F.lit(None).cast("long")
    bins = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("1", "2", "3-5", "6+")))).alias("bin")).join(counts.groupBy(label.alias("bin")).agg(F.sum("k").alias("n")), "bin", "left").crossJoin(total)
    whole = upto.crossJoin(total).agg(F.sum("k").alias("n"), F.min("v").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("v"))).alias("upper_median"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    rows = bins.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), share, no.alias("least"), no.alias("upper_median"), no.alias("most"), F.lit(None).cast("double").alias("mean"))
    return rows.unionByName(whole.select(F.lit("all").alias("bin"), "n", F.lit(100.0).alias("percent"), "least", "upper_median", "most", "mean").filter("n IS NOT NULL"))


CONFUSION = """SELECT glabel, plabel, count(*) AS n FROM {cand} WHERE exact GROUP BY glabel, plabel"""

#: Numbers of labels on both sides and their difference.
LABEL_DELTA = """
SELECT coalesce(g.label, p.label) AS label, coalesce(g.n, 0) AS n_gold, coalesce(p.n, 0) AS n_pred, coalesce(p.n, 0) - coalesce(g.n, 0) AS delta
FROM (SELECT label, count(*) AS n FROM {gold} GROUP BY label) g FULL OUTER JOIN (SELECT label, count(*) AS n FROM {pred} GROUP BY label) p ON g.label = p.label"""

#: Frequencies, ties by first appearance.
FREQUENCY = """
SELECT name, n, cast(rank AS bigint) AS rank FROM (SELECT name, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM (SELECT name, count(*) AS n, min(ord) AS first FROM {names} GROUP BY name) a) b WHERE rank <= {top}"""

#: Shares in percent with two decimals, from exact counts.
WEIGHTS = """
SELECT name, n, floor(cast(n AS double) * 10000 / cast(total AS double) + 0.5) / cast(100 AS double) AS percent FROM (SELECT name, n, sum(n) OVER () AS total FROM (SELECT name, count(*) AS n FROM {names} GROUP BY name) a) b"""

#: Token-level counts: right tags, and per tag the gold, predicted and right.
TOKEN_METRICS = """
SELECT tag, cast(sum(gold) AS bigint) AS n_gold, cast(sum(pred) AS bigint) AS n_pred, cast(sum(hit) AS bigint) AS n_right FROM (
  SELECT gold_tag AS tag, 1 AS gold, 0 AS pred, CASE WHEN gold_tag = pred_tag THEN 1 ELSE 0 END AS hit FROM {tags} UNION ALL SELECT pred_tag, 0, 1, 0 FROM {tags}) x GROUP BY tag"""

#: Recall as a fraction of a support, and whether it restores to a whole number.
RECALL_TABLE = """
SELECT m.key, m.value, s.n AS support, cast(floor(m.value * s.n + 0.5) AS bigint) AS hits, abs(m.value * s.n - floor(m.value * s.n + 0.5)) <= 0.05 AS exact FROM {metrics} m JOIN {supports} s ON s.key = m.key"""

#: Groups that may stay unidentified: fewer than ``allowed`` missed.
ALLOWANCE = """
SELECT grp, cast(sum(1 - matched) AS bigint) AS missed, CASE WHEN sum(1 - matched) <= {allowed} THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT label % 4 AS grp, matched FROM {facts}) x GROUP BY grp"""

SUPPORTS = """SELECT dim, key, count(*) AS n FROM (SELECT 'label' AS dim, label AS key FROM {gold} UNION ALL SELECT 'length', e - s FROM {gold}) x GROUP BY dim, key"""


#: Categories by sensitivity rank, 1 first.
SENSITIVITY = {"주민등록번호": 1, "외국인등록번호": 1, "여권번호": 1, "운전면허번호": 1, "카드번호": 2, "계좌번호": 2, "국문 성명": 3, "영문 성명": 3, "연락처": 3, "이메일 주소": 3, "주소": 3}


def run(statement: str, like: DataFrame, **args) -> DataFrame:
    """A statement above over DataFrames; whole numbers are put in as they are."""
    frames = {}
    for name, value in args.items():
        if isinstance(value, DataFrame):
            frames[name] = value
        else:
            statement = statement.replace("{" + name + "}", str(value))
    return like.sparkSession.sql(statement, **frames)


def buckets(facts: DataFrame) -> DataFrame:
    """What ``BUCKETS`` says, from one pass: each span is dealt to all of its keys."""
    key = lambda dim, x: F.struct(F.lit(dim).alias("dim"), x.alias("key"))
    keys = F.array_compact(F.array(key("all", F.lit("all")), key("label", F.col("label").cast("string")), key("tier", F.col("tier")), F.when(F.col("gi") % 2 == 0, key("case", F.lit("even"))), F.when(F.col("gi") % 3 == 0, key("case", F.lit("third")))))
    part = (F.col("covered") > 0) & (F.col("covered") < F.col("glen"))
    return facts.select(F.explode(keys).alias("k"), "matched", "covered", "glen").groupBy(F.col("k.dim").alias("dim"), F.col("k.key").alias("key")).agg(
        F.count("*").alias("n"), F.sum("matched").cast("long").alias("tp"), F.sum(1 - F.col("matched")).cast("long").alias("fn"), F.count_if(F.col("covered") == F.col("glen")).alias("n_full"),
        F.count_if(part).alias("n_partial"), F.sum(F.when(part, F.col("glen") - F.col("covered")).otherwise(0)).cast("long").alias("exposed"),
    )


def token_counts(tags: DataFrame) -> DataFrame:
    """What ``TOKEN_METRICS`` says, from one pass: each token counts for its gold and its predicted tag."""
    one = lambda tag, gold, hit: F.struct(tag.alias("tag"), F.lit(gold).alias("gold"), F.lit(1 - gold).alias("pred"), hit.alias("hit"))
    both = F.array(one(F.col("gold_tag"), 1, F.when(F.col("gold_tag") == F.col("pred_tag"), 1).otherwise(0)), one(F.col("pred_tag"), 0, F.lit(0)))
    return tags.select(F.explode(both).alias("x")).groupBy(F.col("x.tag").alias("tag")).agg(F.sum("x.gold").cast("long").alias("n_gold"), F.sum("x.pred").cast("long").alias("n_pred"), F.sum("x.hit").cast("long").alias("n_right"))
