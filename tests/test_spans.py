"""Pinned literals and properties of span functions, decoding and sources."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge import functions as fn
from spanforge.operators import corpus, decoding, matching, rules, sampling, summaries, taxonomy
from spanforge.sources import readers, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return row.select(column.alias("x")).first()["x"]


def spans(*xs):
    return ([(s, e, n) for s, e, n in xs], fn.SPANS)


def tuples(x):
    return [tuple(r) for r in x]


def test_unions(spark):
    touching = spans((0, 5, "A"), (5, 9, "B"))
    assert tuples(one(spark, fn.union_of("s", touching=False), s=touching)) == [(0, 5, "A"), (5, 9, "B")]
    assert tuples(one(spark, fn.union_of("s"), s=touching)) == [(0, 9, "A+B")]
    assert tuples(one(spark, fn.union_of("s", touching=False), s=spans((0, 5, "A"), (4, 9, "B")))) == [(0, 9, "A+B")]
    assert tuples(one(spark, fn.wider_wins("s"), s=spans((0, 5, "A"), (4, 10, "B")))) == [(4, 10, "B")]


def test_masks(spark):
    s = spans((0, 5, "private_person"), (18, 28, "private_date"))
    text = ("Alice was born on 1990-01-02.", "string")
    assert one(spark, fn.redacted("t", "s"), t=text, s=s) == "<PRIVATE_PERSON> was born on <PRIVATE_DATE>."
    assert one(spark, fn.masked("t", "s"), t=text, s=s) == "***** was born on **********."
    assert one(spark, fn.typed_mask("t", "s"), t=text, s=s) == "[private_person] was born on [private_date]."
    assert tuples(one(spark, fn.trimmed("t", "s"), t=("  ab\x1c ", "string"), s=spans((0, 6, "x"), (0, 2, "y")))) == [(2, 4, "x")]


def test_rules(spark):
    assert tuples(one(spark, rules.id_spans("t"), t=("890101-1234567은", "string"))) == [(0, 14, "resident")]
    assert one(spark, rules.id_spans("t"), t=("1234567-1234567", "string")) == []
    assert one(spark, fn.luhn("t"), t=("4539578763621486", "string")) and not one(spark, fn.luhn("t"), t=("4539578763621487", "string"))
    assert tuples(one(spark, fn.regex_spans("t", "[0-9]+", "n"), t=("😀 12 é 3", "string"))) == [(2, 4, "n"), (7, 8, "n")]
    assert one(spark, rules.korean_name("t"), t=("남궁민수 씨는 은행원", "string")) == "남궁민수"
    assert one(spark, fn.still_identifiable("t", F.lit(8)), t=("12-34", "string")) and not one(spark, fn.still_identifiable("t", F.lit(9)), t=("12-34", "string"))


def test_enough_overlap(spark):
    got = [one(spark, fn.enough_overlap("o", "n"), o=(o, "int"), n=(n, "int")) for o, n in ((2, 2), (1, 2), (2, 10), (3, 10))]
    assert got == [True, False, False, True]


def tokens(spark, tags, offsets=None):
    rows = [(1, i, *(offsets[i] if offsets else (i, i + 1)), t) for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "doc_id long, ti long, s long, e long, tag string")


def test_tag_dialects(spark):
    t = tokens(spark, ["O", "I-x", "O"])
    assert [(r.s, r.e, r.label) for r in decoding.spans_lenient(t).collect()] == [(1, 2, "x")]
    assert decoding.spans_strict(t).collect() == [] and decoding.illegal(t).first()["n_illegal"] == 2
    t = tokens(spark, ["B-x", "I-x"])
    assert len(decoding.spans_lenient(t).collect()) == len(decoding.spans_by_index(t).collect()) == 1
    assert decoding.spans_strict(t).collect() == [] and decoding.illegal(t).first()["n_illegal"] == 1


CASES = {
    "V1": ([[2, 0, 0, 0, 0], [0, 0, 3, 0, 1], [2, 0, 0, 0, 0]], ["OSO", "OSO", "OOO"], [-3.115828, -2.115828, -2.115828]),
    "V2": ([[0, 2, 0, 0, 0], [0, 0, 2, 0, 0], [1, 0, 1.5, 1.2, 0]], ["BIE"] * 3, [-2.192640, -1.192640, -3.192640]),
    "V3": ([[1.0, 0.8, 0, 0, 0], [0, 0, 2.5, 0, 0], [0, 0, 0, 2.5, 0]], ["BIE"] * 3, [-1.840255, -0.840255, -2.840255]),
    "V4": ([[0, 1, 0, 0, 0.9]], ["S"] * 3, [-1.201434] * 3),
}


@pytest.mark.parametrize("case", CASES)
def test_viterbi_goldens(case):
    logits, paths, scores = CASES[case]
    up = {"background_stay": -1.0, "background_to_start": 1.0, "inside_to_continue": 1.0}
    order = ["O", "B-x", "I-x", "E-x", "S-x"]
    for biases, path, score in zip((None, up, {k: -v for k, v in up.items()}), paths, scores):
        got, s = decoding.best_path(logits, order, biases)
        assert "".join(order[i][0] for i in got) == path and math.isclose(s, score, abs_tol=1e-5)


def test_viterbi_brute_force():
    r = np.random.default_rng(1)
    tags = decoding.classes(["x"])
    legal, bias, first, last = decoding.transitions(tags)
    for n in (1, 2, 4):
        x = r.normal(size=(n, len(tags)))
        z = x - np.log(np.exp(x).sum(1, keepdims=True))
        best = max(
            (sum(z[i, c] for i, c in enumerate(p)) for p in itertools.product(range(len(tags)), repeat=n) if first[p[0]] and last[p[-1]] and all(legal[a, b] for a, b in zip(p, p[1:])))
        )
        assert math.isclose(decoding.best_path(x, tags)[1], best, abs_tol=1e-9)


@pytest.mark.parametrize(
    "record",
    [
        {"text": "ab", "predicted_spans": {"x: a": [[0, 1]], "y: b": [[1, 2]]}},
        {"input": "ab", "predictions": [{"start": 0, "end": 1, "label": "x"}, {"begin": 1, "end_offset": 2, "label": "", "entity": "y"}]},
        {"content": "ab", "entities": [[0, 1, "x"], [1, 2, "y"]]},
    ],
)
def test_span_containers(spark, tmp_path, record):
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(record) + "\n\nnot json\n[1]\n")
    rows, bad = readers.read_lines(spark, str(path))
    got = readers.read_predictions(spark, str(path)).first()
    assert bad == 2 and rows.count() == 1
    assert got["text"] == "ab" and tuples(got["spans"]) == [(0, 1, "x"), (1, 2, "y")]


def test_gold_and_join(spark, tmp_path):
    doc = {"id": "a", "text": "hello", "spans": [{"start": 0, "end": 2, "value": "he", "opf_label": "x"}]}
    path = tmp_path / "g.json"
    for content in ({"documents": [doc]}, [doc]):
        path.write_text(json.dumps(content))
        gold = readers.read_gold(spark, str(path))
        assert readers.gold_spans(gold).first()["category"] == "(미분류)"
    pred = spark.createDataFrame([(0, "a", "hello", [(0, 1, "x")]), (1, "a", "hello", [(1, 2, "x")])], f"ord long, id string, text string, spans {fn.SPANS}")
    assert tuples(readers.by_text(gold, pred).first()["pred_spans"]) == [(1, 2, "x")]
    with pytest.raises(readers.InputError):
        readers.by_text(gold, pred.filter("text = 'other'").union(pred.withColumn("text", F.lit("no"))))


def test_pseudonyms_keep_offsets(spark):
    d = spark.createDataFrame([(1, "card 4539578763621486 and 4539578763621486.", [(5, 21, "card"), (26, 42, "card")])], f"doc_id long, text string, spans {fn.SPANS}")
    r = corpus.pseudonymized(d).select("text", "spans", fn.luhn(fn.span_text("text", F.col("spans")[0]["start"], F.col("spans")[0]["end"])).alias("ok")).first()
    values = [r["text"][x["start"] : x["end"]] for x in r["spans"]]
    assert len(set(values)) == 1 and len(values[0]) == 19 and not r["ok"]


def test_sinks_and_samples(spark):
    d = spark.createDataFrame([(1, "abab", [(0, 2, "x"), (2, 4, "x"), (3, 9, "x")])], f"doc_id long, text string, spans {fn.SPANS}")
    assert json.loads(sinks.prediction_lines(d).first()["value"])["predicted_spans"] == {"x: ab": [[0, 2], [2, 4]]}
    assert sampling.allocate({"a": 100, "b": 50, "c": 40}, 100) == {"a": 35, "b": 33, "c": 32}
    pool = [{"doc": i, "item": i % 2, "bin": "1"} for i in range(4)]
    assert len(taxonomy.stratified(pool, {"1": 3})) == 3


def test_match_properties(spark):
    gold = spark.createDataFrame([(1, 1, 0, 5, 1), (1, 2, 10, 12, 1)], "doc_id long, gi long, s long, e long, label long")
    pred = spark.createDataFrame([(1, 1, 0, 3, 1), (1, 2, 2, 6, 2), (1, 3, 10, 12, 1)], "doc_id long, pi long, s long, e long, label long")
    cand = matching.candidates(gold, pred)
    n = [matching.greedy(cand, c).count() for c in ("strict", "partial", "type")]
    assert n == [1, 2, 2] == sorted(n)
    assert {(r.gi, r.covered) for r in matching.coverage(gold, pred).collect()} == {(1, 5), (2, 2)}
    assert matching.split_cover(gold, pred).collect()[0]["gi"] == 1
    assert [(r.s, r.e) for r in matching.difference(matching.islands(pred), matching.islands(gold)).collect()] == [(5, 6)]


def test_samples_by_blocks(spark):
    """Ranks in blocks give what one sort of all rows gives; strata may be missing, null or under their quota."""
    rows = spark.createDataFrame([(i, "hot" if i % 3 else ("few" if i < 9 else None)) for i in range(3000)], "id long, kind string")
    order = [r["id"] for r in rows.orderBy(F.xxhash64(F.lit(42), "id"), "id").collect()]
    kind = {r["id"]: r["kind"] for r in rows.collect()}
    want = {"hot": 40, "few": 10, "gone": 5}
    got = {r["id"] for r in sampling.hash_sample(rows, "id", want, stratum="kind").collect()}
    assert got == {i for k, n in want.items() for i in [x for x in order if kind[x] == k][:n]}
    assert {r["id"] for r in sampling.hash_sample(rows, "id", 7).collect()} == set(order[:7])
    parts = sampling.split(rows, "id", share=0.13)
    assert {r["id"] for r in parts.filter("part = 'validation'").collect()} == set(order[:390])
    assert parts.columns == ["id", "kind", "part"] and parts.count() == 3000
    for n, valid in ((0, 0), (1, 0), (2, 1)):
        assert sampling.split(rows.filter(F.col("id") < n), "id").filter("part = 'validation'").count() == valid
    odd = spark.createDataFrame([(None,), (5,), (5,), (6,)], "id long")
    assert sorted(r["part"] for r in sampling.split(odd, "id").filter("id IS NULL").collect()) == ["train"]


def test_joins_by_text_and_id(spark):
    gold = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, text string")
    model = spark.createDataFrame([(0, "a", [1]), (1, "a", [2]), (2, None, [3])], "ord long, text string, spans array<int>")
    rule = spark.createDataFrame([(0, "b", [7])], "ord long, text string, spans array<int>")
    out = {r["id"]: (r["model_spans"], r["rule_spans"], r["model_missing"], r["rule_missing"]) for r in summaries.three_way(gold, model, rule).collect()}
    assert out == {"1": ([2], None, False, True), "2": (None, [7], True, False), "3": (None, None, True, True)}
    by_id = spark.createDataFrame([(0, "2", [1]), (4, "2", [9]), (1, "8", [3])], "ord long, id string, spans array<int>")
    assert {r["id"]: r["pred_spans"] for r in summaries.without_text(gold, by_id).collect()} == {"1": None, "2": [9], "3": None}


def test_nothing_meets(spark):
    """A gold without predictions is not covered at all; a prediction without gold masks all its characters in vain."""
    gold = spark.createDataFrame([(1, 1, 0, 5, 1), (1, 2, 20, 26, 1), (2, 1, 3, 4, 1)], "doc_id long, gi long, s long, e long, label long")
    pred = spark.createDataFrame([(1, 1, 3, 7, 1), (1, 2, 6, 9, 1), (1, 3, 40, 44, 1), (3, 1, 2, 5, 1)], "doc_id long, pi long, s long, e long, label long")
    assert {(r.doc_id, r.gi): r.covered for r in matching.coverage(gold, pred).collect()} == {(1, 1): 2, (1, 2): 0, (2, 1): 0}
    assert {(r.doc_id, r.pi): r.over_chars for r in matching.overmask(gold, pred).collect()} == {(1, 1): 2, (1, 2): 2, (1, 3): 4, (3, 1): 3}


def test_probes_meet_their_quota(spark):
    """Ids from 50 on, with gaps and nulls, and fewer documents than probes; surfaces carry no right check digit either."""
    for ids in ([50, 77, None, 77, 10**12], range(1000, 1400)):
        got = corpus.probes(spark.createDataFrame([(i,) for i in ids], "doc_id long"), 50)
        rows = got.select("kind", "n", "value", *(c.alias(k) for k, c in corpus.surfaces(F.col("value"), "n").items())).collect()
        assert sorted((r.kind, r.n) for r in rows) == sorted((k, n) for k in corpus.FORMATS for n in range(50))
        assert len({r.value for r in rows}) == len(rows)
        for r in rows:
            assert sum(c.isdigit() for c in r.cut) >= 4
            for v in r[2:] if r.kind == "card" else ():
                d = [int(c) for c in reversed(v) if c.isdigit()]
                assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10
    assert corpus.probes(spark.createDataFrame([], "doc_id long"), 50).count() == 0
