"""Shared pieces of the training-data operators: written tables, word splitting, cached word encoding."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from array import array
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no shared folder (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bytes of an Arrow batch on its way to a Python worker, where the session names none: rows may be long.
BATCH_BYTES = 16 << 20


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, not in rows alone."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterable, text: str = "text", most_bytes: int = 6 << 20) -> Iterator:
    """Arrow batches cut so that each holds about ``most_bytes`` of text; one row is never cut."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < b.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes)))
            yield b.slice(at, end - at)
            at = end


def word_index(texts):
    """Of an Arrow string column: where each row's words begin (one more entry than rows), each
    word's place in the list of distinct words, and that list as an Arrow array. Words are maximal
    runs without space and U+0009 to U+000D; no Python string is made for a word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets, values = lists.offsets.to_numpy().astype("int64"), lists.values
    values = values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(values)
    index = coded.indices.to_numpy().astype("int64")
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[index] if len(index) else np.zeros(0, bool)
    if not full.all():  # white space at an end gives an empty word
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        index = index[full]
    return offsets, index, coded.dictionary


def joined(index, sizes, starts, flat):
    """The runs ``flat[starts[i] : starts[i] + sizes[i]]`` for every i of ``index``, one after another, and each run's end."""
    import numpy as np

    n = sizes[index]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - n), n)
    return flat[at], ends


def _trim() -> None:
    """Give memory that nothing uses back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker(name: str):
    """Decorator of functions over Arrow batches: a reused Python worker holds the caches of one operator at a time, and each task gives back what it took."""

    def wrap(run):
        @functools.wraps(run)
        def task(batches):
            if Cache.holder != name:
                for c in Cache.all:
                    c.clear()
                gc.collect()
                _trim()
                Cache.holder = name
            yield from run(batches)
            _trim()

        return task

    return wrap


class Cache(dict):
    """A dict filled by ``make`` in bulk, up to ``most`` entries; long keys are never kept.

    Full, it keeps what it has (common keys come early) until under a fifth of the keys asked for are there; then it starts anew.
    """

    #: All caches of this process, and the operator whose entries they hold.
    all: list = []
    holder: str | None = None

    def __init__(self, make, most: int = 200_000, longest: int = 40):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        Cache.all.append(self)

    def values_of(self, keys: list[str]) -> list:
        """The value of each of these distinct keys."""
        out = list(map(self.get, keys))
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            if len(self) >= self.most and 5 * len(new) > 4 * len(keys) > 4_000:
                self.clear()
            asked = [keys[i] for i in new]
            made = self.make(asked)
            for i, v in zip(new, made):
                out[i] = v
            if room := self.most - len(self):
                self.update((k, v) for k, v in zip(asked[:room], made) if len(k) <= self.longest)
        return out


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class WordIds:
    """Ids of whole texts as unsigned 32-bit numbers, word by word.

    The tokenizer drops white space, and neither its normalizer nor its pre-tokenizer looks across
    it, so the ids of a text are those of its words in a row; each distinct word is encoded once.
    A full stop or comma after letters is a piece of its own, and case is dropped. Words of letters
    only go to the model at once, as what the normalizer and pre-tokenizer would make of them. Up to
    ``most`` words of at most ``longest`` bytes are kept, as Arrow strings; full, the cache keeps what
    it has (common words come early) until under a fifth of the words asked for are there; then it
    starts anew.
    """

    _made: dict[str, "WordIds"] = {}

    def __init__(self, path: str, most: int = 400_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest, self.letters = Tokenizer.from_file(path), most, longest, byte_letters()
        self.marks = {m: int(self.alone([m])[0][0]) for m in ".,"}
        self.clear()
        Cache.all.append(self)

    def clear(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.words, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, "int64")

    @classmethod
    def get(cls, path: str) -> "WordIds":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def alone(self, words: list[str]) -> tuple:
        """All ids of these words in a row, and how many each has, by the whole tokenizer."""
        import numpy as np

        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for i in ids for x in i], "<u4"), np.array(list(map(len, ids)), "int64")

    def together(self, words: list[str]) -> tuple:
        """The same of words that are pieces of the pre-tokenizer already, by the model."""
        import numpy as np

        flat, sizes = array("I"), array("q")
        for tokens in map(self.tokenizer.model.tokenize, words):
            flat.extend([x.id for x in tokens])
            sizes.append(len(tokens))
        return np.array(flat, "<u4"), np.array(sizes, "int64")

    def encoded(self, words):
        """Of an Arrow array of words: all ids in a row, and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        easy = pc.match_substring_regex(words, "^[a-z]+[.,]?$").to_numpy(zero_copy_only=False)
        order, other = np.flatnonzero(easy), np.flatnonzero(~easy)
        some = words.take(pa.array(order))
        known = pc.ascii_rtrim(some, ".,").to_pylist()
        stops = {m: np.flatnonzero(pc.ends_with(some, m).to_numpy(zero_copy_only=False)).tolist() for m in self.marks}
        foreign, rest = [], []
        for i, w in zip(other.tolist(), words.take(pa.array(other)).to_pylist()):
            core = w[:-1] if w[-1:] in self.marks else w
            if core.isalpha() and is_normalized("NFC", w) and "\u03a3" not in w and "\u0130" not in w:
                if core is not w:
                    stops[w[-1]].append(len(known))
                foreign.append(i)
                known.append("".join([self.letters[c] for c in core.lower().encode()]))
            else:
                rest.append((i, w))
        flat, sizes = self.together(known)
        ends = np.cumsum(sizes)
        at = np.array([i for x in stops.values() for i in x], "int64")
        flat = np.insert(flat, ends[at], np.repeat(np.array(list(self.marks.values()), "<u4"), list(map(len, stops.values()))))
        sizes[at] += 1
        more, n_more = self.alone([w for _, w in rest])
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, n_more])
        back = np.argsort(np.concatenate([order, np.array(foreign, "int64"), np.array([i for i, _ in rest], "int64")]))
        return joined(back, sizes, np.cumsum(sizes) - sizes, flat)[0], sizes[back]

    def keep(self, words, flat, sizes, asked: int) -> None:
        """Into the cache with these words, as far as there is room."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) >= self.most and 5 * len(words) > 4 * asked > 4_000:
            self.clear()
        short = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) <= self.longest)[: self.most - len(self.words)]
        if len(short):
            ids, _ = joined(short, sizes, np.cumsum(sizes) - sizes, flat)
            self.words = pa.concat_arrays([self.words, words.take(pa.array(short))])
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes[short]])

    def many(self, texts):
        """Of an Arrow string column: all ids in a row, and where each text's ids begin (one more entry than texts)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens' strings heed case
            texts = pc.ascii_lower(texts)
        offsets, index, distinct = word_index(texts)
        known = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype("int64")
        new = np.flatnonzero(known < 0)
        words = distinct.take(pa.array(new))
        made, n_made = self.encoded(words)
        known[new] = len(self.words) + np.arange(len(new))
        flat, sizes = np.concatenate([self.flat, made]), np.concatenate([self.sizes, n_made])
        ids, ends = joined(known[index], sizes, np.cumsum(sizes) - sizes, flat)
        self.keep(words, made, n_made, len(distinct))
        return ids, np.concatenate([[0], ends])[offsets]

    def __call__(self, text: str) -> bytes:
        import pyarrow as pa

        return self.many(pa.array([text], pa.string()))[0].tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rows_of(batches: Iterable, *names: str, step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches, decoded a few hundred at a time."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def chunked(rows: Iterator[tuple], schema, most: int = 20_000, most_bytes: int = 16 << 20, size_of=None) -> Iterator:
    """Arrow batches of ``rows``: at most ``most`` rows, cut early when ``size_of(row)`` adds up to ``most_bytes``."""
    import pyarrow as pa

    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size_of(r) if size_of else 0
        if len(held) >= most or total >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
