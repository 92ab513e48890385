"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on document ids.

``write_tokens`` encodes whole texts and writes them in ascending ``doc_id`` order (ties by text).
Every file holds a contiguous range of ids, every stripe a contiguous range inside it, so readers
split by stripe, and a lookup of a few documents skips files and stripes by their minima and maxima
and row groups by the Bloom filter. ``ids`` is ``array<int>``: ORC stores it with its second
integer run-length encoding.

Null or empty texts become the end id alone. Rows with a null ``doc_id`` come first. Repeated
``doc_id`` rows are all written, one after another. An empty table gives no rows. Other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import WordIds, default_tokenizer, in_batches, slices, text_or_empty, worker, written

#: Text that a file takes at most, about: files do not grow with the input.
FILE_BYTES = 256 << 20
STRIPE_BYTES = 32 << 20
ROW_INDEX_STRIDE = 10_000
BLOOM_FPP = 0.01
END_ID = 1


_FIELDS = "doc_id long, file_no int, row long, n_tokens int, ids array<int>"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The rows of a token file, in the order of the rows in each partition."""

    @worker("words")
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), ("file_no", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])
        enc, file_no, row = WordIds.get(tokenizer), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            n = b.num_rows
            flat, at = enc.many(b.column("text"))
            ids = np.insert(flat, at[1:], end_id)  # behind each text's own
            ends = at + np.arange(n + 1)
            for i in range(0, n, 512):  # small batches: the reader on the other side copies each whole
                k = min(n, i + 512)
                part = pa.ListArray.from_arrays(pa.array((ends[i : k + 1] - ends[i]).astype("int32")), pa.array(ids[ends[i] : ends[k]].astype("int32")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, k - i), pa.array(np.full(k - i, file_no, "int32")), pa.array(np.arange(row + i, row + k)), pa.array(np.diff(ends[i : k + 1]).astype("int32")), part], schema=schema)
            row += n

    return in_batches(docs, run, _FIELDS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Write ``docs`` (doc_id, text) as ORC files in ascending id order. ``files``: None takes one for each ``FILE_BYTES``, the session's shuffle partitions at least."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    (
        encoded(dealt, tokenizer or default_tokenizer(), end_id)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.create.index", "true")
        .option("compression", "zstd").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of a token file; with ``doc_ids`` (a bounded lookup list) only theirs, pruned by ORC's metadata."""
    df = spark.read.schema(_FIELDS).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    ``start`` needs the ids of all documents before: file totals (one row a file) are summed first,
    then a running sum goes over each file's rows.
    """

    @worker("words")
    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("file_no", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            ids = b.column("ids")
            at, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(values[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("file_no"), b.column("row"), b.column("doc_id"), pa.array(np.diff(at).astype("int64")), pa.array(sums, pa.int64())], schema=schema)

    read = read_tokens(spark, path).select("file_no", "row", "doc_id", "ids")
    rows = written(in_batches(read, run, "file_no int, row long, doc_id long, n_tokens long, ids_crc32 long"), "token_digests")
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(before, "file_no")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
