"""Redaction for callers: one object with settings, over columns, frames and single texts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import functions as fn
from spanforge.operators import rules

#: Fixed value: the label of every span when kinds are hidden.
HIDDEN = "redacted"
MODES = ("typed", "redacted")


@dataclass(frozen=True)
class Redactor:
    """``mode``: placeholders by kind, or one for all. ``patterns``: kind to pattern."""

    mode: str = "typed"
    patterns: dict[str, str] = field(default_factory=lambda: rules.TEXT_RULES | rules.ID_RULES)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")

    def with_(self, **settings) -> "Redactor":
        """Another one with these settings changed, as for a single call."""
        return replace(self, **settings)

    def spans(self, text: Column | str) -> Column:
        """Disjoint spans of all patterns, trimmed of white space."""
        out = fn.disjoint(fn.trimmed(text, rules.found(text, self.patterns)))
        return out if self.mode == "typed" else F.transform(out, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(HIDDEN).alias("label")))

    def redacted(self, text: Column | str) -> Column:
        return fn.redacted(text, self.spans(text))

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``spans``, ``redacted_text`` and ``summary`` (span_count, by_label)."""
        d = docs.withColumn("spans", self.spans(text))
        summary = F.struct(F.size("spans").alias("span_count"), fn.by_label("spans").alias("by_label"))
        return d.withColumn("redacted_text", fn.redacted(text, "spans")).withColumn("summary", summary)

    def redact(self, spark: SparkSession, text: str) -> dict:
        """One text, as a dictionary: text, redacted_text, detected spans, summary."""
        r = self.transform(spark.createDataFrame([(text,)], "text string")).first()
        found = [{"label": s.label, "start": s.start, "end": s.end, "text": text[s.start : s.end]} for s in r["spans"]]
        return {"text": text, "redacted_text": r["redacted_text"], "detected_spans": found, "summary": r["summary"].asDict(True) | {"output_mode": self.mode}}
