"""Readers: corpora, prediction lines in their many shapes, records, transcripts, settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import functions as fn
from spanforge.functions import SPANS

# fixed values: accepted keys, first present wins
TEXT_KEYS = ("text", "input_text", "input", "content", "document")
SPAN_KEYS = ("predictions", "predicted_spans", "pred_spans", "prediction", "entities", "pred", "spans")
ID_KEYS = ("id", "doc_id", "example_id")
START_KEYS, END_KEYS, LABEL_KEYS = ("start", "start_offset", "begin"), ("end", "end_offset"), ("label", "type", "entity", "entity_type", "class")

GOLD_DOCUMENT = """struct<id:string,source_uid:string,split:string,text:string,masked_text:string,
 spans:array<struct<start:int,end:int,value:string,source_label:string,corp_category:string,corp_group:string,opf_label:string,pseudonymized:boolean,injected:boolean>>,
 meta:struct<n_spans:int,n_injected:int,finance_context:boolean,difficulty_cases:array<string>,char_len:int,word_len:int>>"""


class InputError(ValueError):
    """Input that cannot be used: nothing there, an unreadable line, ambiguous formats, unmatched texts."""


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a gold JSON file, an object with ``documents`` or a bare list, with their place ``ord``."""
    whole = spark.read.text(path, wholetext=True)
    inside = F.from_json(F.get_json_object("value", "$.documents"), f"array<{GOLD_DOCUMENT}>")
    docs = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{GOLD_DOCUMENT}>")), inside)
    out = whole.select(F.posexplode(docs).alias("ord", "d")).select("ord", "d.*")
    if out.limit(1).count() == 0:
        raise InputError(f"no documents in {path}")
    return out


def gold_spans(docs: DataFrame) -> DataFrame:
    """One row a gold span: (doc_id, gi, start, end, value, category, grp, label)."""
    return docs.select(F.col("id").alias("doc_id"), F.posexplode("spans").alias("gi", "x")).select(
        "doc_id", "gi", "x.start", "x.end", "x.value", F.coalesce("x.corp_category", F.lit("(미분류)")).alias("category"), F.col("x.corp_group").alias("grp"), F.coalesce("x.opf_label", F.lit("(무라벨)")).alias("label")
    )


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Records of a JSONL file as (ord, raw, v variant), blank lines skipped, and how many lines were no JSON object. None at all is an error."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.select("ord", F.col("value").alias("raw"), F.try_parse_json("value").alias("v"), F.json_object_keys("value").isNotNull().alias("ok"))
    counts = parsed.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")).first()
    if not counts["good"]:
        raise InputError(f"no records in {path}")
    return parsed.filter("ok").drop("ok"), counts["bad"]


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSONL files (a file, a pattern, or a folder of gzip files); the first bad line ends the read. Addresses with a scheme are refused."""
    if "://" in path and not path.startswith(("file:", "viewfs:", "hdfs:")):
        raise InputError(f"local paths only: {path}")
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def alias(v: Column | str, keys: tuple[str, ...], kind: str = "string") -> Column:
    """The first key's value that is there with the right type."""
    return F.coalesce(*(F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$.{k}", kind) for k in keys))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, text, spans) of prediction lines under any accepted key and container."""
    rows, _ = read_lines(spark, path)
    return rows.select("ord", alias("v", ID_KEYS).alias("id"), alias("v", TEXT_KEYS).alias("text"), spans_in("raw").alias("spans"))


def spans_in(raw: Column | str) -> Column:
    """Spans of a JSON record: a map ``"label: value" -> [[s, e]]``, a list of objects, or a list of lists.

    The first present container counts. A map keeps its order; its label is what stands before the
    first colon. In objects the first key present gives the offset even if null; labels skip empty ones.
    """
    r = F.col(raw) if isinstance(raw, str) else raw
    held = F.coalesce(*(F.get_json_object(r, f"$.{k}") for k in SPAN_KEYS))
    pairs = F.map_entries(F.from_json(held, "map<string,array<array<int>>>"))
    mapped = F.flatten(F.transform(pairs, lambda kv: F.transform(kv["value"], lambda p: F.struct(F.get(p, 0).alias("start"), F.get(p, 1).alias("end"), F.trim(F.substring_index(kv["key"], ":", 1)).alias("label")))))
    items = F.from_json(held, "array<string>")

    def first(x: Column, keys: tuple[str, ...]) -> Column:
        names = F.json_object_keys(x)
        out = F.lit(None).cast("string")
        for k in reversed(keys):
            out = F.when(F.array_contains(names, k), F.get_json_object(x, f"$.{k}")).otherwise(out)
        return out.cast("int")

    objects = F.transform(
        items,
        lambda x: F.when(
            F.ltrim(x).startswith("["), F.struct(F.get_json_object(x, "$[0]").cast("int").alias("start"), F.get_json_object(x, "$[1]").cast("int").alias("end"), F.coalesce(F.get_json_object(x, "$[2]"), F.lit("")).alias("label"))
        ).otherwise(F.struct(first(x, START_KEYS).alias("start"), first(x, END_KEYS).alias("end"), F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in LABEL_KEYS), F.lit("")).alias("label"))),
    )
    chosen = F.when(F.ltrim(held).startswith("{"), mapped).otherwise(objects)
    return F.filter(F.coalesce(chosen, F.array().cast(SPANS)), lambda s: s["start"].isNotNull() & s["end"].isNotNull()).cast(SPANS)


def detect_format(records: DataFrame, first: int = 200) -> str:
    """``harness`` (maps or example ids) or ``simple`` (lists), by the keys of the first records; neither or both is an error."""
    keys = records.orderBy("ord").limit(first).select(F.explode(F.json_object_keys("raw")).alias("k")).distinct()
    found = {r["k"] for r in keys.collect()}  # keys of at most `first` records
    harness, simple = bool(found & {"predicted_spans", "example_id"}), bool(found & {"predictions", "entities", "prediction", "pred"})
    if harness == simple:
        raise InputError(f"format not clear from the keys {sorted(found)}")
    return "harness" if harness else "simple"


def parse_record(raw: Column | str) -> Column:
    """Spans of a harness record, strict: ``spans`` maps (label before the first ``": "``) or a ``label`` list; offsets must be whole numbers."""
    r = F.col(raw) if isinstance(raw, str) else raw
    pairs = F.map_entries(F.from_json(F.get_json_object(r, "$.spans"), "map<string,array<array<string>>>"))

    def whole(x: Column) -> Column:
        return F.when(x.rlike("^-?[0-9]+$"), x.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), F.coalesce(x, F.lit("null")))).cast("int"))

    mapped = F.flatten(F.transform(pairs, lambda kv: F.transform(kv["value"], lambda p: F.struct(whole(F.get(p, 0)).alias("start"), whole(F.get(p, 1)).alias("end"), F.substring_index(kv["key"], ": ", 1).alias("label")))))
    listed = F.transform(F.from_json(F.get_json_object(r, "$.label"), "array<struct<category:string,start:string,end:string>>"), lambda x: F.struct(whole(x["start"]).alias("start"), whole(x["end"]).alias("end"), x["category"].alias("label")))
    return F.coalesce(mapped, listed, F.array().cast(SPANS)).cast(SPANS)


def example_id(text: Column | str, index: Column | str) -> Column:
    """A deterministic id: the digest of the canonical JSON of text and file order."""
    t, i = (F.col(x) if isinstance(x, str) else x for x in (text, index))
    return F.sha2(F.concat(F.lit('{"index": '), i.cast("string"), F.lit(', "text": '), F.get(F.split(F.to_json(F.struct(t.alias("t"))), r'^\{"t":', 2), 1), F.lit("")), 256)


def expand_messages(docs: DataFrame) -> DataFrame:
    """One row a message of a transcript: (doc_id, message_index, role, text, spans), spans that lie inside, moved to the message.

    A message begins at ``user: `` or ``assistant: `` at the start or behind an empty line.
    """
    mark = r"(?:^|\n\n)(?:user|assistant): "
    hits = F.regexp_extract_all("text", F.lit(mark), F.lit(0))
    gaps = F.split("text", mark, -1)
    steps = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 2, F.greatest(F.size(hits), F.lit(0))).alias("body"))
    walked = F.aggregate(
        steps,
        F.struct(F.length(F.get(gaps, F.lit(0))).alias("at"), F.array().cast("array<struct<role:string,text:string,at:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["hit"]) + F.length(x["body"])).alias("at"),
            F.array_append(a["out"], F.struct(F.regexp_replace(F.trim(F.regexp_replace(x["hit"], r"\n", "")), ":.*", "").alias("role"), x["body"].alias("text"), (a["at"] + F.length(x["hit"])).alias("at"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    rows = docs.select("doc_id", "spans", F.posexplode(walked).alias("message_index", "m"))
    inside = F.filter("spans", lambda s: (s["start"] >= F.col("m.at")) & (s["end"] <= F.col("m.at") + F.length("m.text")))
    moved = F.transform(inside, lambda s: F.struct((s["start"] - F.col("m.at")).alias("start"), (s["end"] - F.col("m.at")).alias("end"), s["label"].alias("label")))
    return rows.select("doc_id", "message_index", F.col("m.role").alias("role"), F.col("m.text").alias("text"), moved.alias("spans"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def lines_of(spark: SparkSession, lines) -> DataFrame:
    """Lines (standard input, a prompt) as documents; blank ones skipped."""
    return spark.createDataFrame([(i, s.rstrip("\n")) for i, s in enumerate(lines) if s.strip()], "doc_id long, text string")


def calibration(path: str | None) -> dict[str, float]:
    """Transition biases of a settings file, with exactly the known keys; no file means all zero."""
    from spanforge.operators.decoding import BIASES

    if path is None:
        return dict.fromkeys(BIASES, 0.0)
    with open(path) as f:
        given = json.load(f)["operating_points"]["default"]["biases"]
    given = {k.removeprefix("transition_bias_"): v for k, v in given.items()}
    if set(given) != set(BIASES):
        raise InputError(f"keys must be {BIASES}, not {sorted(given)}")
    return {k: float(v) for k, v in given.items()}


#: Classes of the label space versions known by name.
TAXONOMIES = {
    "v4": ("private_person", "other_person", "personal_url", "other_url", "personal_location", "other_location", "personal_email", "other_email", "personal_phone", "other_phone", "personal_date", "other_date", "personal_id", "secret"),
    "v7": (
        "personal_name", "personal_handle", "other_person", "personal_email", "other_email", "personal_phone", "other_phone", "personal_location", "other_location", "personal_url", "other_url", "personal_org", "personal_gov_id",
        "personal_fin_id", "personal_health_id", "personal_device_id", "personal_vehicle_id", "personal_property_id", "personal_edu_id", "personal_emp_id", "personal_membership_id", "personal_registry_id", "personal_date", "secret", "secret_url",
    ),
    "v2": ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret"),
}


def label_space(spec: dict | None = None) -> list[str]:
    """BIOES classes from a custom list (``span_class_names``, with or without ``O``), a version, a class count, or the default."""
    from spanforge.operators.decoding import classes

    spec = spec or {}
    if names := spec.get("span_class_names"):
        names = [n for n in names if n != "O"]
        if len(set(names)) != len(names) or not all(names):
            raise InputError("class names must be distinct and not empty")
        return classes(names)
    version = spec.get("category_version", "v2")
    if version not in TAXONOMIES:
        raise InputError(f"unknown version {version}; give span_class_names")
    out = classes(list(TAXONOMIES[version]))
    if spec.get("num_labels", len(out)) != len(out):
        raise InputError(f"{spec['num_labels']} labels do not fit {version}, which has {len(out)}")
    return out


def by_text(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold documents with their predictions by equal text, the last of repeated ones; any unmatched gold is an error.

    Falls back to ids only if no prediction has a text.
    """
    from pyspark.sql import Window

    key = "text" if pred.filter("text IS NOT NULL").limit(1).count() else "id"
    last = pred.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter("_rn = 1").select(F.col(key).alias("_key"), F.col("spans").alias("pred_spans"))
    joined = gold.join(last, gold[key] == F.col("_key"), "left")
    if n := joined.filter("_key IS NULL").count():
        raise InputError(f"{n} gold documents have no prediction")
    return joined.drop("_key")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a probe JSONL file: (id, text, spans, probe_type), ``spans`` by start, then end, with value, category and label.

    Lines that are no objects and records without a text are passed over; the category is the record's, else the span's
    label; the id is the record's, else ``PROBE-`` and its place among the records. No record at all is an error.
    """
    rows, _ = read_lines(spark, path)
    text = alias("v", ("text",))
    category = F.get_json_object("raw", "$.info.corp_category")
    d = rows.select("ord", text.alias("text"), F.array_sort(parse_record("raw")).alias("x"), category.alias("category"), F.coalesce(F.get_json_object("raw", "$.info.id"), F.get_json_object("raw", "$.id")).alias("id"), F.coalesce(F.get_json_object("raw", "$.info.probe_type"), F.lit("?")).alias("probe_type")).filter("text IS NOT NULL")
    spans = F.transform("x", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), fn.span_text(F.col("text"), x["start"], x["end"]).alias("value"), F.coalesce(F.col("category"), x["label"]).alias("category"), x["label"].alias("label")))
    return d.select(F.coalesce("id", F.concat(F.lit("PROBE-"), F.lpad((F.col("ord") + 1).cast("string"), 5, "0"))).alias("id"), "text", spans.alias("spans"), "probe_type")


def read_scores(spark: SparkSession, archive: str, meta: str) -> DataFrame:
    """(doc_id, text, offsets, scores) of cached scores: an archive of one matrix a document and a JSONL file of texts and token offsets.

    The archive is read once, a matrix at a time; texts without a matrix keep null scores.
    """

    def matrices(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        yield pd.DataFrame({"doc_id": [name], "scores": [z[name].astype("float32").tolist()]})

    scores = spark.read.format("binaryFile").load(archive).select("content").mapInPandas(matrices, "doc_id string, scores array<array<float>>")
    lines = spark.read.schema("doc_id string, text string, offsets array<array<int>>").json(meta, mode="FAILFAST")
    return lines.join(scores, "doc_id", "left")


def first_documents(docs: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` documents in file order."""
    return docs.orderBy("ord").limit(n)
