"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``m`` half keys each are made from ``2 * m * r`` minhashes; the ``m * m`` tables
are keyed by all pairs of a left and a right half key, so far fewer minhashes are computed than
``m * m`` separate keys of ``2 * r`` would need. A pair of similarity s misses every table only if it
misses all left or all right halves: at most ``2 * (1 - s^r)^m`` (1.5e-4 at 0.85 with r=3, m=10).

1. Signatures: one pass over the texts. Equal sets are one class from here on (known by a number of
   its own, as ids may repeat), so groups of exact copies cost nothing further.
2. Half keys that only one class has are dropped (counted with partial sums), then tables are keyed.
3. In every bucket each member is paired with one centre (another one for each left half), which is linear in the bucket.
   The distinct pairs are confirmed on full sets, and linked classes labelled.
4. Buckets that still hold several labels may hide links between two non-centres. Their members are
   compared by sketch and then by full sets wherever labels differ, each pair in the first left
   half it shares, in blocks of ``BLOCK`` members; only links that join labels come out.
5. Labels over all confirmed links are the components, by contraction in hash order, each round a
   written table, so lost executors cost one round.

Words are runs without space and U+0009 to U+000D, A-Z lower-cased. A text with fewer words than a
shingle has its whole sequence as its only shingle; an empty or null text has none and is linked
with nothing. Rows that repeat a ``doc_id`` each come back, and each goes by its own text: an id does
not join the texts that it stands under. A null ``doc_id`` has no component and is kept. An empty table gives no rows. Working
columns are prefixed where the caller's columns pass through (``dedup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import Cache, in_batches, slices, text_or_empty, word_index, worker, written

SHINGLE, PERCENT = 3, 85
R, M = 3, 10
#: Members of a bucket compared with each other in one task.
BLOCK, BLOCK_SHINGLES = 1_024, 2_000_000
#: Bins of the second sketch (the least hash of each range, 16 bits of it), used to compare pairs only.
BINS = 128
#: Standard errors that the sketches of a pair may fall short of the similarity.
SLACK = 4.0
#: Ids of candidate documents that are broadcast at most (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Bits of a row of the bitmap that ``without`` broadcasts, and of the whole at most (32 MB): 64 a removed row, fewer from 4 million on.
PAGE_BITS, MAX_BITS = 1 << 15, 1 << 28
_LEFT = "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, sig array<int>"


def _hash_words(keys: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(k) for k in keys]


_WORDS: dict[str, Cache] = {}


def shingles_of(texts, k: int) -> list:
    """The sorted distinct 64-bit shingle hashes of each text of an Arrow string column."""
    import numpy as np
    import pyarrow.compute as pc

    at, index, distinct = word_index(pc.ascii_lower(texts))
    cache = _WORDS.setdefault("words", Cache(_hash_words))
    words = np.array(cache.values_of(distinct.to_pylist()), "uint64")[index] if len(index) else np.zeros(0, "uint64")
    n = len(words)
    mixed = np.zeros(n, "uint64")
    for j in range(k):  # windows over the whole batch; those across texts are cut off below
        mixed[: max(0, n - j)] = mixed[: max(0, n - j)] * np.uint64(0x9E3779B97F4A7C15) + words[j:]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= k:
            out.append(np.unique(mixed[s : e - k + 1]))
        elif e > s:
            one = e - s
            for w in words[s:e].tolist():
                one = (one * 0x9E3779B97F4A7C15 + w) % 2**64
            out.append(np.array([one], "uint64"))
        else:
            out.append(np.zeros(0, "uint64"))
    return out


def multipliers(n: int):
    """Odd multipliers and offsets of ``n`` hash functions, from a fixed stream."""
    import numpy as np

    x, out = 0x243F6A8885A308D3, []
    for _ in range(2 * n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x ^ (x >> 29))
    return np.array(out[:n], "uint64") | np.uint64(1), np.array(out[n:], "uint64")


def signatures(docs: DataFrame, k: int, r: int, m: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_hi, set_lo, sig) of documents without null texts: the set's size and digest, its minhashes (32 bits each) and then the bins (two in 32 bits)."""

    @worker("minhash")
    def run(batches):
        import numpy as np
        import pyarrow as pa

        a, b = multipliers(2 * r * m)
        n_ints = len(a) + BINS // 2
        bounds = np.arange(1, BINS, dtype="uint64") * np.uint64(2**64 // BINS)
        for batch in slices(batches, most_bytes=6 << 20):
            sets = shingles_of(batch.column("text"), k)
            sig = np.zeros((len(sets), n_ints), "uint32")
            full = [i for i, s in enumerate(sets) if len(s)]
            for i in full:
                x = sets[i]
                for f in range(0, len(a), 12):
                    y = x[None, :] * a[f : f + 12, None] + b[f : f + 12, None]
                    sig[i, f : f + y.shape[0]] = (y >> np.uint64(32)).min(1)
                starts = np.concatenate([[0], np.searchsorted(x, bounds)])  # sets are sorted
                held = np.diff(starts, append=len(x)) > 0
                bins = np.zeros(BINS, "uint16")
                bins[held] = (x[starts[held]] >> np.uint64(20)).astype("uint16") | np.uint16(1)  # 0: none
                sig[i, len(a) :] = bins.view("uint32")
            hi, lo = zip(*map(digest, sets))
            flat = pa.array(sig.ravel().view("int32"))
            offsets = pa.array((np.arange(len(sets) + 1) * n_ints).astype("int32"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "sig"]
            )

    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, _LEFT)


def half_keys(reps: DataFrame, r: int, m: int) -> DataFrame:
    """(rep, side, i, half) of every class."""
    parts = [f"named_struct('side', {s}, 'i', {i}, 'half', xxhash64({s}, {i}, {', '.join(f'sig[{(s * m + i) * r + j}]' for j in range(r))}))" for s in (0, 1) for i in range(m)]
    return reps.select("rep", F.expr(f"explode(array({', '.join(parts)}))").alias("h")).select("rep", "h.*")


def buckets(reps: DataFrame, r: int, m: int) -> DataFrame:
    """(key, i, j, rep) of the tables whose key at least two classes share."""
    halves = half_keys(reps, r, m)
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    kept = halves.join(shared, "half").groupBy("rep").agg(F.collect_list(F.struct("side", "i", "half")).alias("hs"))  # at most 2 * m of each class
    keyed = kept.select("rep", F.explode(F.filter("hs", lambda h: h["side"] == 0)).alias("a"), F.filter("hs", lambda h: h["side"] == 1).alias("bs")).select("rep", "a", F.explode("bs").alias("b"))
    keyed = written(keyed.select(F.xxhash64("a.half", "b.half").alias("key"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), "rep"), "tensor_keys")
    many = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("i", "rep"), "rep")).getField("rep").alias("centre")).filter("n > 1")
    return keyed.join(many, "key").select("key", "i", "j", "rep", "n", "centre")


def digest(x) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(x.tobytes())
    return (d >> 64) - 2**63, d % 2**64 - 2**63


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, set) of some classes (rep, doc_id, set_hi, set_lo): sorted shingle hashes of a text of each. Few ids are broadcast, so that only their texts travel."""
    wanted = written(wanted, "wanted")
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)

    @worker("minhash")
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            sets = shingles_of(batch.column("text"), k)
            hi, lo = zip(*map(digest, sets))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype("int32"))
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view("int64")))], names=["set_hi", "set_lo", "set"])

    made = in_batches(docs.join(ids, "doc_id", "left_semi").select("text"), run, "set_hi long, set_lo long, set array<long>")
    one = made.groupBy("set_hi", "set_lo").agg(F.first("set").alias("set"))  # a repeated id brings other texts too
    return written(one.join(wanted, ["set_hi", "set_lo"]).select("rep", "set"), "wanted_sets")


def sets_in(batch, name: str) -> list:
    """The sets of an Arrow list column."""
    import numpy as np

    column = batch.column(name)
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.split(column.flatten().to_numpy().view("uint64"), np.cumsum(column.value_lengths().to_numpy())[:-1])


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; sets travel only for pairs' members."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = sets_of(docs, reps.join(ends, "rep", "left_semi").select("rep", "doc_id", "set_hi", "set_lo"), k)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")

    @worker("minhash")
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(sets_in(batch, "set_a"), sets_in(batch, "set_b")):
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(n > 0 and 100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return in_batches(both.select("a", "b", "set_a", "set_b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ends of ``links`` (a, b): label is the smallest id reachable.

    Each round every vertex points to its least neighbour in hash order, and links are contracted
    along the pointers: a constant share of vertices goes each time, whatever the ids' order, and
    stars go at once. Rounds are written tables; only whether links are left reaches the driver.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("label")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        to = both.groupBy(F.col("a").alias("v")).agg(F.min(order("b")).alias("m")).select("v", F.least("m", order("v")).getField("v").alias("to"))
        to = written(to, "pointers")
        moved = edges.join(to.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        labels = written(labels.join(to.select(F.col("v").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return written(labels.join(least, "label").select("id", F.col("least").alias("label")), "components")


def residual_links(members: DataFrame, r: int, m: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of different labels that share a left half key, at least one for each two labels that have any.

    ``members``: (rep, label, n_shingles, sig, set) of classes whose buckets hold several labels. A pair is
    looked at in the first left half it shares: sizes and sketches first, then full sets. No pair
    leaves a task, only links, and those only while they join labels. Groups are dealt as
    pairs of blocks of ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles, so no task holds more than
    two blocks whatever a group's size.
    """
    keys = [f"named_struct('i', {i}, 'half', xxhash64(0, {i}, {', '.join(f'sig[{i * r + j}]' for j in range(r))}))" for i in range(m)]
    halves = members.select("rep", "label", "n_shingles", F.expr(f"explode(array({', '.join(keys)}))").alias("h")).select("rep", "label", "n_shingles", "h.*")
    stats = halves.groupBy("half").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min("label").alias("first"), F.max("label").alias("last")).filter("first < last")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = halves.select("rep", "i", "half").join(stats.select("half", blocks.alias("blocks")), "half").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "i", "half", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = written(dealt, "residual_places").join(members, "rep")
    share, n_hashes = percent / 100, 2 * r * m

    def run(group):
        import numpy as np
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        label, rep, size = (group.column(c).to_numpy().copy() for c in ("label", "rep", "n_shingles"))
        ids, counts = np.unique(label, return_counts=True)
        if len(ids) > 1:
            i, lo, hi = (group.column(c)[0].as_py() for c in ("i", "lo", "hi"))
            own = group.column("own").to_numpy()
            sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            bins = np.ascontiguousarray(sig[:, n_hashes:]).view("uint16")
            sig = sig[:, :n_hashes]
            sets = sets_in(group, "set")
            ends = np.cumsum(size)
            flat = np.concatenate(sets)
            common = ids[counts.argmax()]
            for x in np.flatnonzero(label != common).tolist():  # of two labels one at least is not the commonest
                ok = (label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
                if lo != hi:
                    ok &= own != own[x]
                y = np.flatnonzero(ok)
                if not len(y):
                    continue
                same = sig[y] == sig[x]
                seen = n_hashes + ((bins[y] != 0) | (bins[x] != 0)).sum(1)
                alike = same.sum(1) + ((bins[y] == bins[x]) & (bins[x] != 0)).sum(1)
                near = alike / seen >= share - SLACK * np.sqrt(share * (1 - share) / seen)
                near &= same[:, : m * r].reshape(len(y), m, r).all(2).argmax(1) == i
                y = y[near]
                if not len(y):
                    continue
                each = size[y]
                at = np.cumsum(each) - each
                both = flat[np.arange(each.sum()) + np.repeat(ends[y] - each - at, each)]
                place = np.minimum(np.searchsorted(sets[x], both), len(sets[x]) - 1)
                n = np.add.reduceat((sets[x][place] == both).astype("int64"), at)
                for j in y[100 * n >= percent * (each + size[x] - n)].tolist():
                    if label[j] != label[x]:
                        out.append((min(int(rep[x]), int(rep[j])), max(int(rep[x]), int(rep[j]))))
                        label[label == label[j]] = label[x]
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return full.groupBy("half", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, r: int = R, m: int = M) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return labelled_rows(docs, k, percent, r, m).drop("text_hash")


def labelled_rows(docs: DataFrame, k: int, percent: int, r: int, m: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = written(signatures(docs, k, r, m), "signatures")
    real = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = real.groupBy("set_hi", "set_lo").agg(F.min_by(F.struct("doc_id", "n_shingles", "sig"), "doc_id").alias("first"))
    # the number that stands for a class is fixed by writing it
    reps = written(first.select(F.monotonically_increasing_id().alias("rep"), "first.doc_id", "set_hi", "set_lo", "first.n_shingles", "first.sig"), "reps")
    classes = reps.select("set_hi", "set_lo", F.col("doc_id").alias("least"), "rep")

    tables = written(buckets(reps, r, m), "tables")
    star = tables.filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    sizes = reps.select("rep", "n_shingles")
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    star = star.join(sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b")), "b").filter(fits).select("a", "b")
    links = written(confirmed(written(star, "star_pairs"), docs, reps, k, percent), "star_links")

    labels = components(links)
    labelled = tables.filter("n > 2").join(labels, F.col("rep") == F.col("id"), "left").select("key", "i", "j", "n", "rep", F.coalesce("label", "rep").alias("label"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    open_reps = written(labelled.join(mixed, "key").select("rep", "label").distinct(), "open_reps")
    open_rows = open_reps.join(reps, "rep")
    members = open_rows.join(sets_of(docs, open_rows.select("rep", "doc_id", "set_hi", "set_lo"), k), "rep").select("rep", "label", "n_shingles", "sig", "set")
    more_links = residual_links(written(members, "members"), r, m, percent)
    known = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))  # one link a class stands for all found so far
    final = components(known.unionByName(more_links))
    named = classes.join(final, F.col("rep") == F.col("id"), "left").select("set_hi", "set_lo", "least", F.coalesce("label", "rep").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").select("set_hi", "set_lo", "component")
    out = rows.join(named, ["set_hi", "set_lo"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, r: int = R, m: int = 12) -> DataFrame:
    """``docs`` with one document of each component; all columns stay. Of equal rows, all stay or go."""
    gone = labelled_rows(docs, k, percent, r, m).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct()
    return without(docs, written(gone, "gone"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for rows whose id and hash of text are in ``gone`` (_gone, _gone_text). Rows that a bitmap of ``gone`` leaves out stay where they are; only the others travel, to be joined."""
    bits = min(MAX_BITS, max(PAGE_BITS, 1 << (64 * gone.count()).bit_length()))
    keys = lambda d: (d["doc_id"].cast("long"), F.xxhash64(F.coalesce(d["text"].cast("string"), F.lit(""))))
    spot = lambda *key: F.pmod(F.xxhash64(*key), F.lit(bits))
    page = lambda x: F.floor(x / PAGE_BITS)
    marks = gone.select(spot("_gone", "_gone_text").alias("x")).select(page(F.col("x")).alias("_gone_page"), (F.col("x") % PAGE_BITS).alias("x"))
    marks = marks.repartition("_gone_page").groupBy("_gone_page").agg(F.bitmap_construct_agg("x").alias("_gone_bits"))
    x = spot(*keys(docs))
    at = (x % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(marks["_gone_bits"], F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    rows = docs.join(F.broadcast(marks), page(x) == marks["_gone_page"], "left")
    doc_id, text = keys(docs)
    found = rows.filter(marked).select(docs["*"]).join(gone, (doc_id == gone["_gone"]) & (text == gone["_gone_text"]), "left_anti")
    return rows.filter(~marked).select(docs["*"]).union(found)


def oracle(k: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL for ``near_duplicates``: all links by shared shingles, components by recursion."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
                  ELSE list_distinct([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) END) AS g FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
     e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
     r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
     m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id"""
