"""Best-fit packing of documents into fixed-length training sequences by bin completion.

A document's ids (plus an end id) that do not fit one sequence are cut into pieces of the full
capacity; the last piece may be shorter. How many pieces of each length exist is all that packing
needs, so the search runs over that histogram: at most ``capacity`` rows, however many documents
there are. It takes the largest length left, enumerates undominated fillings for the rest of the
sequence, and repeats a filling as often as the counts allow (less often later). Branches whose waste
cannot beat the incumbent are cut; the first incumbent is best-fit decreasing. Passes widen until one
has left nothing out. ``MAX_NODES`` alone ends the search early, and bounds it, not the result: every
piece is packed whichever solution stands then. The search goes as deep as there are patterns; only
the ``OPEN_LEVELS`` deepest levels hold their choices, a level above finds them again when the search is back there.

Pieces then find their places without meeting in one task: each gets its rank among those of its
length (ranks are dealt in blocks), and the rank picks sequence and offset from the patterns.

Null or empty texts are one piece with the end id alone. Repeated rows and ids are separate
documents, null ``doc_id`` included. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import WordIds, default_tokenizer, in_batches, slices, text_or_empty, worker, written

CAPACITY = 2048
END_ID = 0
#: Choices looked at in the whole search, and choices followed at each level in its first pass.
MAX_NODES, FIRST_WIDTH = 100_000, 3
#: Levels of the search whose choices are held (about 0.1 MB each).
OPEN_LEVELS = 64
#: Pieces ranked together.
BLOCK_ROWS = 200_000

Patterns = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Patterns:
    """Best-fit decreasing over a histogram: bins alike are one group."""
    groups: dict[int, list[list]] = defaultdict(list)  # room left: [lengths, how many]
    rooms: list[int] = []

    def put(room: int, lens: tuple, n: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append([lens, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_right(rooms, length - 1)
            if i == len(rooms):
                each = min(left, capacity // length)
                n = left // each
                put(capacity - each * length, (length,) * each, n)
            else:
                room = rooms[i]
                lens, have = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
                each = min(left, room // length)
                n = min(have, left // each)
                if have > n:
                    put(room, lens, have - n)
                put(room - each * length, lens + (length,) * each, n)
            left -= n * each
    return [(lens, n) for g in groups.values() for lens, n in g]


def dominated(filling: tuple[int, ...], waste: int, counts: dict[int, int], here: int) -> bool:
    """Whether one unused length still fits, or could stand for one or two of the filling's and still fit. ``here`` has a bit for each length there is."""
    times = Counter(filling)
    for x, k in times.items():
        if counts[x] == k:
            here &= ~(1 << x)
    wide = (1 << (waste + 1)) - 1
    lens = list(times)
    return bool(
        here & wide
        or any(here >> (s + 1) & wide >> 1 for s in lens)
        or any(here >> (x + y) & wide for i, x in enumerate(lens) for y in lens[i + (times[x] == 1) :])
    )


def fillings(room: int, counts: dict[int, int], most_waste: int) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of ``room`` that wastes at most ``most_waste``, one by one, and None for each that was dominated.

    Pairs that fill the room come first, then the filling of each sum that takes the larger lengths
    first, by waste, then all others by waste.
    """
    lens = sorted(x for x, n in counts.items() if n and x <= room)
    if not lens:
        if room <= most_waste:
            yield ()
        return
    if lens[-1] == room:
        yield (room,)  # one length that fills the room dominates all else
        return
    done = set()
    for a in reversed(lens):
        b = room - a
        if b > a:
            break
        if counts.get(b, 0) > (a == b):
            done.add((a, b))
            yield a, b
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in lens:
        if reach[-1] >> x == mask >> x:  # every sum from here on: no larger length adds one
            reach += [reach[-1]] * (len(lens) + 1 - len(reach))
            break
        bits, n, k = reach[-1], min(counts[x], room // x), 1
        while n:
            k = min(k, n)
            bits |= (bits << (x * k)) & mask
            n, k = n - k, k * 2
        reach.append(bits)
    digits = bytearray(b"0") * (lens[-1] + 1)
    for x in lens:
        digits[-1 - x] = 49
    here = int(digits, 2)

    def of(s: int) -> Iterator[tuple[int, ...]]:
        """The fillings of sum ``s``, larger lengths first."""
        stack = [(s, len(lens), ())]
        while stack:
            left, i, out = stack.pop()
            if not left:
                yield out
                continue
            i = bisect_right(lens, left, 0, i)
            x = lens[i - 1]
            stack += [(left - k * x, i - 1, out + (x,) * k) for k in range(min(counts[x], left // x) + 1) if reach[i - 1] >> (left - k * x) & 1]

    sums = [s for s in range(reach[-1].bit_length() - 1, max(room - most_waste, 1) - 1, -1) if reach[-1] >> s & 1]
    for later in (0, 1):
        for s in sums:
            for filling in islice(of(s), later, None if later else 1):
                if filling not in done:
                    yield None if dominated(filling, room - s, counts, here) else filling


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by tokens, and by lengths of which no two share one."""
    return max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Patterns:
    """Patterns (lengths, how often) that hold every length of the histogram.

    A pass tries so many choices at each level; when it ends without the bound, a wider one follows,
    until one has left nothing out (its best is then the least there is) or the nodes are spent.
    """
    counts = {int(x): int(n) for x, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    least, n_best = lower_bound(counts, capacity), sum(n for _, n in best)
    total = sum(x * n for x, n in counts.items())
    nodes, width, whole = 0, FIRST_WIDTH, not counts

    def options(state: dict[int, int], most_waste: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
        """The largest length with each filling as often as the counts allow, then with each less often."""
        largest, again = max(state), []
        left = {**state, largest: state[largest] - 1}
        for f in fillings(capacity - largest, left, most_waste):
            if f is None:
                yield None
                continue
            lens = (largest, *f)
            n = min(state[x] // k for x, k in Counter(lens).items())
            if n > 1:
                again.append((lens, n))
            yield lens, n
        for lens, n in again:
            for k in range(n - 1, 0, -1):
                yield lens, k

    def change(state: dict[int, int], lens: tuple[int, ...], by: int) -> None:
        for x in lens:
            state[x] = state.get(x, 0) + by
            if not state[x]:
                del state[x]

    while not whole and n_best > least and nodes < max_nodes:
        whole = True
        path: Patterns = []
        state, used, tokens = dict(counts), 0, total
        stack = [[None, 0, 0, (n_best - 1) * capacity - total]]  # choices, how many were followed and looked at, most waste
        while stack and n_best > least and nodes < max_nodes:
            level = stack[-1]
            if level[0] is None:  # new, or let go of; the state is again what it was
                level[0] = islice(options(dict(state), level[3]), level[2], None)
            step = next(level[0], stack)
            level[2] += 1
            if step is not stack and level[1] == width:
                whole, step = False, stack
            if step is stack:  # no more choices here
                stack.pop()
                if path:
                    lens, n = path.pop()
                    change(state, lens, n)
                    used, tokens = used - n, tokens + n * sum(lens)
                continue
            nodes += 1
            if step is None:
                continue
            lens, n = step
            after = tokens - n * sum(lens)
            if used + n + -(-after // capacity) >= n_best:  # wastes too much to beat the incumbent
                continue
            level[1] += 1
            change(state, lens, -n)
            used, tokens = used + n, after
            path.append((lens, n))
            if state:
                stack.append([None, 0, 0, (n_best - 1 - used) * capacity - tokens])
                if len(stack) > OPEN_LEVELS:
                    stack[-1 - OPEN_LEVELS][0] = None
            else:
                best, n_best = list(path), used
                path.pop()
                change(state, lens, n)
                used, tokens = used - n, tokens + n * sum(lens)
        width *= 3
    return best


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    path = tokenizer or default_tokenizer()

    @worker("words")
    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        enc = WordIds.get(path)
        for b in slices(batches):
            flat, at = enc.many(b.column("text"))
            ids = np.ascontiguousarray(np.insert(flat, at[1:], end_id), "<u4")
            ends = at + np.arange(len(at))
            out = []
            for doc, s, e in zip(b.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                out += [(doc, k, p - s, min(capacity, e - p), zlib.crc32(ids[p : min(e, p + capacity)])) for k, p in enumerate(range(s, e, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def places(patterns: Patterns) -> dict[int, tuple[list, list, list, list]]:
    """By length: first rank of each run, its first sequence, how many a sequence holds, and their offsets."""
    out: dict[int, tuple[list, list, list, list]] = defaultdict(lambda: ([], [], [], []))
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for lens, n in patterns:
        at, offsets = 0, defaultdict(list)
        for x in lens:
            offsets[x].append(at)
            at += x
        for x, o in offsets.items():
            for column, v in zip(out[x], (rank[x], sequence, len(o), o)):
                column.append(v)
            rank[x] += n * len(o)
        sequence += n
    return dict(out)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    table = places(bin_completion({r["length"]: r["count"] for r in histogram}, capacity))
    blocks = max(1, -(-sum(r["count"] for r in histogram) // BLOCK_ROWS))

    rows = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    sizes = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("inside", F.row_number().over(order) - 1).join(before, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for b in batches:
            ids, offsets = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                first, sequence, each, at = table[length]
                i = bisect_right(first, rank) - 1
                copy, which = divmod(rank - first[i], each[i])
                ids.append(sequence[i] + copy)
                offsets.append(at[i][which])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in schema.names[:5]), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], schema=schema)

    return in_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
