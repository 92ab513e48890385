"""Token counts of a unigram model without its tokens: a count-only Viterbi pass.

An Aho-Corasick automaton enumerates all vocabulary matches of a segment; dynamic programming
carries the best score and the number of pieces to each position, nothing else. The rules are those
of the ``tokenizers`` library's unigram model over the same vocabulary, space escaped as U+2581 and
one put in front: a candidate replaces another only if its score is strictly higher, so that the
earliest start wins ties; a character that no piece covers alone may be an unknown at the lowest
score less 10; unknowns count their UTF-8 bytes (byte fallback). Scores are whole numbers, so sums
are exact in any order. No piece holds an escaped space behind another character, hence paths meet
at each such place and segments are scored apart, each distinct segment once.

The vocabulary comes from a public file whose path is a parameter. Null or empty texts count 0. Repeated rows
and null ids each keep their row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import Cache, joined, in_batches, slices, text_or_empty, worker

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class UnigramCounter:
    _made: dict[str, "UnigramCounter"] = {}

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p, _ in vocab) or not all(float(s).is_integer() for _, s in vocab):
            raise ValueError("segments can only be scored apart if no piece holds a space inside and all scores are whole numbers")
        self.cache = Cache(lambda keys: list(map(self.count, keys)))

    @classmethod
    def get(cls, path: str) -> "UnigramCounter":
        if path not in cls._made:
            cls._made[path] = cls(vocabulary(path))
        return cls._made[path]

    def count(self, segment: str) -> int:
        """Pieces of the best path over one segment (spaces escaped)."""
        n = len(segment)
        score, pieces = [0.0] + [None] * n, [0] * (n + 1)
        done = 0
        unknown = self.unknown

        def close(end: int, matches: list) -> None:
            """Settle position ``end`` from its matches, longest (earliest start) first."""
            best, count, alone = None, 0, False
            for length, s in matches:
                c = score[end - length] + s
                alone = alone or length == 1
                if best is None or c > best:
                    best, count = c, pieces[end - length] + 1
            if not alone:
                c = score[end - 1] + unknown
                if best is None or c > best:
                    best, count = c, pieces[end - 1] + len(segment[end - 1].encode("utf-8", "surrogatepass"))
            score[end], pieces[end] = best, count

        held: list = []
        for last, match in self.automaton.iter(segment):
            if last != done:
                while done < last:
                    close(done + 1, held)
                    held, done = [], done + 1
            held.append(match)
        while done < n:
            close(done + 1, held)
            held, done = [], done + 1
        return pieces[n]

    def many(self, texts):
        """Counts of an Arrow string column."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")  # an escaped space in the text is a space
        # a run of spaces belongs to the word behind it
        lists = pc.split_pattern(texts, " ")
        offsets, values = lists.offsets.to_numpy().astype("int64"), lists.values
        coded = pc.dictionary_encode(values.slice(offsets[0], offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        keys, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype("int64")
        sums = np.concatenate([[0], np.cumsum(np.array(self.cache.values_of([SPACE + k for k in keys]), "int64")[index])])
        out = np.diff(sums[offsets])
        empty = index == keys.index("") if "" in keys else np.zeros(len(index), bool)
        odd = np.diff(np.concatenate([[0], np.cumsum(empty)])[offsets]) > 0  # runs of spaces, or an empty text
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out

    def whole(self, text: str) -> int:
        if not text:
            return 0
        segments, run = [], 0
        for part in text.split(" "):
            run += 1
            if part:
                segments.append(SPACE * run + part)
                run = 0
        if run:
            segments.append(SPACE * run)
        return sum(self.count(s) if len(s) > 64 else self.cache.values_of([s])[0] for s in segments)


def count_tokens(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    path = vocab or default_vocabulary()

    @worker("token_counts")
    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(UnigramCounter.get(path).many(b.column("text")))], names=["doc_id", "n_tokens"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, n_tokens long")
