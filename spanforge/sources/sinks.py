"""Writers: prediction and harness lines, metrics, review sheets, score caches, side-by-side pages."""

from __future__ import annotations

import html
import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import span_text


def span_map(text: Column | str, spans: Column | str) -> Column:
    """``"label: value" -> [[s, e], ...]`` of the valid spans; a key that repeats gets all its ranges."""
    t, s = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    valid = F.filter(s, lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(t)))
    name = lambda x: F.concat(x["label"], F.lit(": "), span_text(t, x["start"], x["end"]))
    keys = F.array_distinct(F.transform(valid, name))
    ranges = lambda k: F.transform(F.filter(valid, lambda x: name(x) == k), lambda x: F.array(x["start"], x["end"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, ranges(k))))


def prediction_lines(docs: DataFrame) -> DataFrame:
    """One JSON line a document (doc_id, text, spans), in the harness form."""
    return docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("example_id"), "text", span_map("text", "spans").alias("predicted_spans"))).alias("value"))


def harness_lines(docs: DataFrame) -> DataFrame:
    """Gold documents as evaluation lines."""
    return docs.select(F.to_json(F.struct("text", span_map("text", "spans").alias("spans"), F.struct(F.col("doc_id").cast("string").alias("id"), F.size("spans").alias("n_spans"), F.length("text").alias("char_len")).alias("info"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def metrics_json(metrics: DataFrame, path: str, config: dict | None = None) -> dict:
    """A long (key, value) table of metrics as one JSON file: a bounded number of keys."""
    out = {"summary": {"n": None}, "metrics": {r["key"]: r["value"] for r in metrics.orderBy("key").collect()}, "config": config or {}}
    out["summary"]["n"] = len(out["metrics"])
    with open(path, "w") as f:
        json.dump(out, f, ensure_ascii=False, indent=1)
    return out


class Timings:
    """Seconds by stage: ``lap(name)`` ends a stage; ``write`` puts them in a file with counts, settings and rates."""

    def __enter__(self) -> "Timings":
        self.began = self.last = time.monotonic()
        self.seconds: dict[str, float] = {}
        return self

    def __exit__(self, *_) -> None:
        self.seconds["overall_wall"] = time.monotonic() - self.began

    def lap(self, name: str) -> None:
        now = time.monotonic()
        self.seconds[name] = self.seconds.get(name, 0.0) + now - self.last
        self.last = now

    def write(self, path: str, counts: dict[str, int], config: dict) -> None:
        wall = self.seconds["overall_wall"]
        out = {"counts": counts, "config": config, "timings_seconds": self.seconds, "throughput_per_second": {k: n / wall if wall else None for k, n in counts.items()}}
        with open(path, "w") as f:
            json.dump(out, f, indent=2, sort_keys=True)


def nested(metrics: dict, key: str):
    """A metric by its dotted key, flat or nested."""
    if key in metrics:
        return metrics[key]
    for part in key.split("."):
        if not isinstance(metrics, dict) or part not in metrics:
            return None
        metrics = metrics[part]
    return metrics


def review_csv(rows: DataFrame, path: str, order: str = "doc_id") -> None:
    """A review sheet as CSV with byte order mark. A sheet is a sample for people to read, so it fits the driver."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows(tuple(r) for r in rows.orderBy(order).toLocalIterator())


def write_scores(scores: DataFrame, path: str) -> None:
    """Logits as Parquet, 32-bit."""
    scores.withColumn("logits", F.col("logits").cast("array<array<float>>")).write.parquet(path)


def side_by_side(cards: list[dict]) -> str:
    """A page of cards (title, text, gold, pred as (s, e) lists) with painted characters: gold, prediction, both."""

    def painted(c: dict) -> str:
        kinds = [0] * len(c["text"])
        for bit, spans in ((1, c["gold"]), (2, c["pred"])):
            for s, e in spans:
                for i in range(max(0, s), min(len(kinds), e)):
                    kinds[i] |= bit
        out, at = [], 0
        while at < len(kinds):
            end = at
            while end < len(kinds) and kinds[end] == kinds[at]:
                end += 1
            part = html.escape(c["text"][at:end])
            out.append(f'<span class="k{kinds[at]}">{part}</span>' if kinds[at] else part)
            at = end
        return "".join(out)

    style = ".k1{background:#fdd}.k2{background:#ddf}.k3{background:#dfd}article{border:1px solid #999;padding:8px;margin:8px;white-space:pre-wrap}"
    return f'<!DOCTYPE html><meta charset="utf-8"><style>{style}</style>' + "".join(f"<article><h3>{html.escape(c['title'])}</h3>{painted(c)}</article>" for c in cards)


def rebuilt_pool(base: dict, computed: dict, inherited: tuple[str, ...] = ("romanization", "address", "email_domains")) -> dict:
    """A pool of names rebuilt: computed keys replace their own, others are inherited in order, and every name must have a Latin form."""
    if missing := [k for k in inherited if k not in base]:
        raise ValueError(f"the pool lacks {missing}")
    for kind, names in (("surname", computed.get("surnames", [])), ("given", computed.get("given", []))):
        latin = base["romanization"].get(kind) or {}
        if missing := [n for n in names if n not in latin]:
            raise ValueError(f"no Latin form of {kind}: {missing}")
    return {k: computed.get(k, v) for k, v in base.items()} | {k: v for k, v in computed.items() if k not in base}
