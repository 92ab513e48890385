"""Error taxonomy: tags of each gold, prediction and document, and picks of examples.

The facts of a gold carry both decodings, the match, the representative prediction and the text, so
that the axes are one wide projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("F1_ORPHAN", "F2_FORM", "F3_NARR", "F5_MISLABEL", "F6_OVERRUN", "F7_INCONSIST", "H1_RULE", "H2_OPF_ONLY", "V1_DECODE", "V2_REGRESS")

# Cue words in the characters before a span, honorifics in what a prediction adds, items that rules find
CONTEXT_CHARS = 15
FORM_CUES = ("성명", "직책", "담당자", "이름")
ADDRESS_ITEM = ADDRESS_CUE = "주소"
HONORIFICS = ("님", "씨", "수석", "팀장", "과장", "차장", "부장", "PB")
RULE_ITEMS = ("주민등록번호", "외국인등록번호", "여권번호", "운전면허번호")
NAME_ITEMS = ("국문 성명", "영문 성명")

def gold_axes(facts: DataFrame) -> DataFrame:
    """(doc_id, gi, axis): one row for each gold and axis that holds, from one projection of the facts.

    ``facts``: s, e, item, label, glen, text, coverage and match of both decodings (``_a``: the first), the representative
    prediction (rep_s, rep_e, rep_label), null where there is none, and the items of its document found in full and not at all
    (full_items, none_items).
    """
    reach = F.least(F.col("s"), F.lit(CONTEXT_CHARS)).cast("int")
    before = F.substring("text", (F.col("s") - reach + 1).cast("int"), reach)
    beyond = F.concat(*(F.substring("text", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")) for a, b in ((F.col("rep_s"), F.col("s")), (F.col("e"), F.col("rep_e")))))
    any_of = lambda words, text: reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))
    none, full, ruled = F.col("covered") == 0, F.col("covered") == F.col("glen"), F.col("item").isin(*RULE_ITEMS)
    holds = {
        "F1_ORPHAN": ~none & ~full, "F2_FORM": none & F.col("item").isin(*NAME_ITEMS) & any_of(FORM_CUES, F.col("_before")), "F3_NARR": none & (F.col("item") == ADDRESS_ITEM) & ~F.contains("_before", F.lit(ADDRESS_CUE)),
        "F5_MISLABEL": (F.col("rep_s") == F.col("s")) & (F.col("rep_e") == F.col("e")) & (F.col("rep_label") != F.col("label")), "F6_OVERRUN": any_of(HONORIFICS, F.col("_beyond")), "F7_INCONSIST": F.array_contains("full_items", F.col("item")) & F.array_contains("none_items", F.col("item")),
        "H1_RULE": ruled & (F.col("matched") == 0), "H2_OPF_ONLY": ~ruled & full, "V1_DECODE": (F.col("matched") == 1) & (F.col("matched_a") == 0), "V2_REGRESS": (F.col("covered_a") > 0) & none,
    }
    cued = facts.withColumns({"_before": before, "_beyond": beyond})
    axes = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in holds.items())))
    return cued.select("doc_id", "gi", F.explode_outer(axes).alias("axis")).filter("axis IS NOT NULL")


POPULATIONS = """SELECT axis, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {axes} GROUP BY axis"""

#: Predictions that touch no gold, of one label.
UNLABELED = """
SELECT p.doc_id, p.pi FROM {pred} p WHERE p.label = {label} AND NOT EXISTS (SELECT 1 FROM {gold} g WHERE g.doc_id = p.doc_id AND g.s < p.e AND p.s < g.e)"""

#: Documents with gold, all matched.
STRONG = """SELECT doc_id, count(*) AS n FROM {facts} GROUP BY doc_id HAVING min(matched) = 1"""

#: The first examples of each axis, one a document.
TOP_PER_AXIS = """
SELECT axis, doc_id, gi, cast(rn AS bigint) AS rn FROM (SELECT axis, doc_id, gi, row_number() OVER (PARTITION BY axis ORDER BY doc_id, gi) AS rn
  FROM (SELECT axis, doc_id, gi, row_number() OVER (PARTITION BY axis, doc_id ORDER BY gi) AS own FROM {axes}) a WHERE own = 1) b WHERE rn <= {top}"""

#: Items in turn from each of four labels until there are enough.
ROUND_ROBIN = """
SELECT label, doc_id, gi, cast(pick AS bigint) AS pick FROM (SELECT *, row_number() OVER (ORDER BY rn, label) AS pick FROM (
  SELECT label, doc_id, gi, row_number() OVER (PARTITION BY label ORDER BY doc_id, gi) AS rn FROM {gold} WHERE label IN (0, 1, 2, 3)) a WHERE rn <= {top}) b WHERE pick <= {top}"""

#: Documents by number of golds, all covered in full.
TOP_DOCS = """
SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS rn FROM (SELECT doc_id, count(*) AS n FROM {facts} GROUP BY doc_id HAVING sum(CASE WHEN covered = glen THEN 0 ELSE 1 END) = 0) a) b WHERE rn <= {top}"""

#: Partial golds with most left open.
TOP_PARTIAL = """
SELECT doc_id, gi, glen - covered AS left_open FROM {facts} WHERE covered > 0 AND covered < glen ORDER BY glen - covered DESC, cast(doc_id AS varchar(20)), gi LIMIT {top}"""


def stratified(pool: list[dict], quotas: dict[str, int], per_item: int = 2, relaxed: int = 3) -> list[dict]:
    """Pick by bin quotas from a bounded, ranked pool (dicts with doc, item, bin): one a document, at most ``per_item`` of an item, then ``relaxed``, then the next bin.

    Each choice depends on those before, so this runs on the driver over tens of rows.
    """
    picked: list[dict] = []

    def take(bins: set[str], most: int, want: int) -> None:
        for row in pool:
            if want <= sum(p["quota"] == quota for p in picked):
                return
            if row["bin"] in bins and row["doc"] not in {p["doc"] for p in picked} and sum(p["item"] == row["item"] for p in picked) < most:
                picked.append(row | {"quota": quota})

    order = list(quotas)
    for i, quota in enumerate(order):
        near = {order[j] for j in (i - 1, i + 1) if 0 <= j < len(order)}
        for bins, most in (({quota}, per_item), ({quota}, relaxed), (near, relaxed)):
            take(bins, most, quotas[quota])
    return picked
