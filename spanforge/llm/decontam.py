"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

Words are runs of letters and digits, lower-cased. Each mask reads some of the words of a short
window and ignores the others, so a substituted word at an ignored place does not hide a hit. Seeds
of benchmark items and documents are joined on their hash; around each hit the words of both sides
are laid over each other and compared: a document is contaminated if, in some run of ``REGION``
aligned words (the whole item if it is shorter) at least ``MIN_MATCH_PERCENT`` are equal. Hash
collisions cannot pass that comparison.

The seeds of the benchmark are broadcast only while they number at most ``MAX_BROADCAST_SEEDS``
(counted first, about 60 bytes each); then hits are verified where they are found and nothing but
verified alignments leaves the stage. Beyond that, places and keys (no words) meet the seeds by
shuffle, and the words of documents with hits are fetched by id. Both ways give the same rows.

What the masks cannot see: with a passage of 15 words alone, all ways to substitute one or two of
them are found and 454 of 455 ways to substitute three (places 3, 7, 11 are missed); items of 5, 6,
7, 10 and 11 words miss some of the substitutions that the percentage allows, and items of fewer
than 5 words are not found.

Null or empty texts on either side give no hits, as do items shorter than the shortest mask.
Documents are known by ``doc_id``: rows that repeat one are reported once, null ids never. Repeated
items count by ``item_id``. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import written

#: Places of a window that a mask reads.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
REGION, MIN_MATCH_PERCENT = 15, 80
MAX_BROADCAST_SEEDS = 1_000_000
SPLIT = r"[^\p{L}\p{N}]+"


def _words(text: str) -> str:
    return rf"array_remove(split(lower(coalesce(cast({text} AS string), '')), r'{SPLIT}', -1), '')"


def _seeds(words: str, pos: str) -> str:
    """The hash of each mask at ``pos``; null where it does not fit."""
    return f"array({', '.join(f'CASE WHEN {pos} + {max(mask)} < size({words}) THEN xxhash64({m}, ' + ', '.join(f'{words}[{pos} + {k}]' for k in mask) + ') END' for m, mask in enumerate(MASKS))})"


#: Most equal words in a run of ``n_region``, bound step by step: a column read inside a lambda would be computed for each element.
_BEST = f"""transform(array(zip_with(w, slice(bw, bpos - before + 1, size(w)), (x, y) -> if(x = y, 1, 0))), eq ->
    transform(array(aggregate(eq, 0, (a, x) -> a + x)), total -> CASE
      WHEN 100 * total < {MIN_MATCH_PERCENT} * n_region THEN 0
      WHEN total = size(eq) THEN least(total, n_region)
      ELSE array_max(transform(sequence(1, greatest(1, size(eq) - n_region + 1)), i -> aggregate(slice(eq, i, n_region), 0, (a, x) -> a + x))) END)[0])[0]"""


def hits(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_match, n_region) of each verified alignment; one may come from several seeds."""
    items = written(benchmark.select("item_id", F.expr(_words("text")).alias("bw")).filter("item_id IS NOT NULL AND size(bw) > 0").distinct(), "benchmark_words")
    seeds = items.select("item_id", "bw", F.expr("posexplode(bw)").alias("bpos", "_")).select("item_id", "bpos", F.expr(f"explode({_seeds('bw', 'bpos')})").alias("key")).filter("key IS NOT NULL")
    seeds = written(seeds, "benchmark_seeds")
    few = seeds.count() <= max_broadcast
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_words("text")).alias("w")).filter("doc_id IS NOT NULL")
    places = words.select("doc_id", "w", F.expr("posexplode(w)").alias("pos", "_"))
    keyed = places.select("doc_id", *(["w"] if few else []), "pos", F.expr(f"explode({_seeds('w', 'pos')})").alias("key"))
    if few:
        found = keyed.join(F.broadcast(seeds), "key")
    else:
        found = keyed.filter("key IS NOT NULL").join(seeds, "key").select("doc_id", "pos", "item_id", "bpos").distinct().join(words, "doc_id")
    # the words of the document that may lie over the item's
    reach = REGION + max(max(m) for m in MASKS)
    around = found.select("doc_id", "item_id", "bpos", F.least("pos", "bpos", F.lit(reach)).alias("before"), F.expr(f"slice(w, pos - least(pos, bpos, {reach}) + 1, least(pos, bpos, {reach}) + {reach})").alias("w"))
    laid = around.join(F.broadcast(items) if few else items, "item_id").withColumn("n_region", F.expr(f"least({REGION}, size(bw))"))
    return laid.select("doc_id", "item_id", F.expr(_BEST).alias("n_match"), "n_region").filter(f"100 * n_match >= {MIN_MATCH_PERCENT} * n_region")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_items, first_item_id, item_ids, best_percent) of each document with a passage of a benchmark item."""
    pairs = hits(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.expr("cast(floor(100 * n_match / n_region) AS bigint)")).alias("percent"))
    return pairs.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("first_item_id"), F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("item_ids"), F.max("percent").alias("best_percent")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated; all columns stay."""
    bad = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id")), "contaminated")
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad_id"], "left_anti")


def oracle() -> str:
    """DuckDB SQL for ``contaminated``: the same masks over joined words in place of hashes."""
    seeds = lambda w, p: " UNION ALL ".join(
        f"SELECT *, {m} AS mask, concat_ws(' ', {', '.join(f'{w}[{p} + {k + 1}]' for k in mask)}) AS key FROM src WHERE {p} + {max(mask)} < len({w})" for m, mask in enumerate(MASKS)
    )
    words = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SPLIT}'), lambda x: x <> '')"
    reach = REGION + max(max(m) for m in MASKS)
    return rf"""
WITH b AS (SELECT DISTINCT item_id, {words} AS bw FROM benchmark WHERE item_id IS NOT NULL),
     d AS (SELECT DISTINCT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
     bs AS (WITH src AS (SELECT item_id, bw, unnest(range(0, len(bw))) AS bpos FROM b) {seeds('bw', 'bpos')}),
     ds AS (WITH src AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d) {seeds('w', 'pos')}),
     h AS (SELECT DISTINCT ds.doc_id, bs.item_id, pos, bpos FROM ds JOIN bs ON ds.mask = bs.mask AND ds.key = bs.key),
     l AS (SELECT h.doc_id, h.item_id, least(pos, bpos, {reach}) AS before, pos, bpos, d.w, b.bw, least({REGION}, len(b.bw)) AS n_region
           FROM h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
     a AS (SELECT doc_id, item_id, n_region, w[pos - before + 1:pos + {reach}] AS ww, bw[bpos - before + 1:bpos + {reach}] AS ww2 FROM l),
     e AS (SELECT doc_id, item_id, n_region, [CASE WHEN ww[i] = ww2[i] THEN 1 ELSE 0 END FOR i IN range(1, least(len(ww), len(ww2)) + 1)] AS eq FROM a),
     m AS (SELECT doc_id, item_id, n_region, list_max([list_sum(eq[i:i + n_region - 1]) FOR i IN range(1, greatest(2, len(eq) - n_region + 2))]) AS n_match FROM e),
     p AS (SELECT doc_id, item_id, max(floor(100 * n_match / n_region))::BIGINT AS percent FROM m WHERE 100 * n_match >= {MIN_MATCH_PERCENT} * n_region GROUP BY ALL)
SELECT doc_id, count(*)::BIGINT AS n_items, min(item_id) AS first_item_id, array_to_string(list_sort(list(item_id)), ',') AS item_ids, max(percent) AS best_percent
FROM p GROUP BY doc_id"""
