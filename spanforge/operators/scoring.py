"""Tokens with character ranges, and windowed scores from a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Encode = Callable[[list[str]], list[list[tuple[int, bytes]]]]
Score = Callable[[list[list[int]]], list]


def char_ranges(text: str, pieces: list[bytes]) -> tuple[list[int], list[int]]:
    """First character and end of each token of a text, from the tokens' bytes, which must begin the text.

    A token takes every character it shares a byte with, so tokens that split one character share it.
    """
    import numpy as np

    raw = text.encode()
    if not raw.startswith(b"".join(pieces)):
        raise ValueError("the tokens' bytes do not begin the text")
    begins = np.append((np.frombuffer(raw, "u1") & 0xC0) != 0x80, True)  # True behind the last byte, too
    begun = np.concatenate([[0], np.cumsum(begins[:-1])])  # characters begun before each byte
    sizes = np.array([len(p) for p in pieces], "int64")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = begun[starts] - ~begins[starts]
    return first.tolist(), np.maximum(begun[ends], first).tolist()


def tokenized(docs: DataFrame, load: Callable[[], Encode]) -> DataFrame:
    """(doc_id, ids, starts, ends) of ``docs(doc_id, text)``. ``load`` runs once a partition and gives a function
    from texts to tokens (id, bytes). A null text has no tokens."""

    def run(batches):
        import pandas as pd

        encode = load()
        for df in batches:
            texts = [t or "" for t in df["text"]]
            made = encode(texts)
            ranges = [char_ranges(t, [p for _, p in m]) for t, m in zip(texts, made, strict=True)]
            yield pd.DataFrame({"doc_id": df["doc_id"], "ids": [[i for i, _ in m] for m in made], "starts": [a for a, _ in ranges], "ends": [b for _, b in ranges]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def scored(tokens: DataFrame, load: Callable[[], Score], window: int, batch: int = 16) -> DataFrame:
    """(doc_id, logits) of ``tokens(doc_id, ids)``: ids go to the model in windows that do not overlap, ``batch`` at a
    time, across documents. ``load`` runs once a partition; the model gives one row of class scores a token, or it is
    an error. A document without tokens has no scores."""
    if window < 1 or batch < 1:
        raise ValueError("window and batch must be positive")

    def run(frames):
        import pandas as pd

        score = load()
        for df in frames:
            ids = [list(x) if x is not None else [] for x in df["ids"]]
            parts = [(d, x[i : i + window]) for d, x in enumerate(ids) for i in range(0, len(x), window)]
            logits: list[list] = [[] for _ in ids]
            for i in range(0, len(parts), batch):
                some = parts[i : i + batch]
                for (d, x), out in zip(some, score([x for _, x in some]), strict=True):
                    if len(out) != len(x):
                        raise ValueError(f"{len(out)} rows of scores for {len(x)} tokens")
                    logits[d].extend([float(v) for v in row] for row in out)
            yield pd.DataFrame({"doc_id": df["doc_id"], "logits": logits})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, logits array<array<double>>")
