"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group is all rows of one text and lies on one shard. Only a group that no shard can hold, with
more than an even share of the bytes, tokens or rows, is split, by document id, into parts of about
``1 / PARTS`` of a shard. Groups over that size are placed one by one (at most ``3 * shards *
PARTS`` can be); the rest share ``cells`` by the hash of their text, whole groups in each. So the
table of what is placed has a fixed bound whatever the input, and is placed on the driver: largest
first, each on the shard whose residual capacity has the highest dot product with its vector. The
law that holds is ``bytes``: sizes are near equal, as far as whole groups allow.

Tokens are ids of the tokenizer, whole texts. A null text has no bytes; it groups with the empty
text. Repeated rows each get a slot; null ids are allowed. An empty table gives no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import WordIds, default_tokenizer, in_batches, slices, text_or_empty, worker, written

SHARDS = 40
CELLS = 16_384
PARTS = 64
ROW_BYTES = 16


def place(cells: list[tuple], shards: int) -> list[int]:
    """The shard of each cell (bytes, tokens, rows), by highest dot product with the residual capacity.

    Capacity is the even share of each dimension; a full shard's residual turns negative, which
    sends large cells elsewhere. Ties take the lowest shard.
    """
    import numpy as np

    size = np.array(cells, float).reshape(len(cells), 3)
    size = size / np.maximum(size.sum(0) / shards, 1e-9)
    residual = np.ones((shards, 3))
    out = [0] * len(cells)
    for i in np.argsort(-size.max(1), kind="stable"):
        shard = int(np.argmax(residual @ size[i]))
        residual[shard] -= size[i]
        out[i] = shard
    return out


def measured(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, size, text_crc32, n_tokens, group) of every document."""

    @worker("words")
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            n = np.diff(WordIds.get(tokenizer).many(b.column("text"))[1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(n.astype("int64")), b.column("group")], names=["doc_id", "size", "text_crc32", "n_tokens", "group"])

    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"), text.alias("text"),
    )
    return in_batches(rows, run, "doc_id long, size long, text_crc32 long, n_tokens long, group long")


def assign(docs: DataFrame, shards: int = SHARDS, n_cells: int = CELLS, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, n_tokens, law, shard, slot, grown_shard) of every document."""
    rows = written(measured(docs, tokenizer or default_tokenizer()), "shard_rows")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")), "shard_groups")
    even = [max(1, (s or 0) / shards) for s in groups.agg(F.sum("size"), F.sum("n_tokens"), F.sum("n")).first()]
    share = F.greatest(F.col("size") / even[0], F.col("n_tokens") / even[1], F.col("n") / even[2])
    # at most 3 * shards * PARTS groups are over the bound, and their parts at most three times as many
    large = groups.filter(share * PARTS > 1).select("group", F.when(share > 1, F.ceil(share * PARTS)).otherwise(1).cast("long").alias("parts")).orderBy("group").collect()
    first, at = [], n_cells
    for r in large:
        first.append((r["group"], at, r["parts"]))
        at += r["parts"]
    spark = docs.sparkSession
    own = spark.createDataFrame(first, "group long, first_cell long, parts long")
    shared_cell = F.pmod(F.xxhash64("group"), F.lit(n_cells))
    own_cell = F.col("first_cell") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    celled = rows.join(F.broadcast(own), "group", "left").withColumn("cell", F.coalesce(own_cell, shared_cell))
    # one row a cell: bounded by n_cells plus the large groups and parts
    cells = celled.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")).orderBy("cell").collect()
    taken, placed = [0] * shards, []
    for r, shard in zip(cells, place([(r["size"], r["n_tokens"], r["n"]) for r in cells], shards)):
        placed.append((r["cell"], shard, taken[shard]))
        taken[shard] += r["n"]
    where = spark.createDataFrame(placed, "cell long, shard int, before long")
    slot = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return celled.join(F.broadcast(where), "cell").select(
        "doc_id", "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
