"""Report tables, widths and escapes, probe records and cached scores."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import display
from spanforge.operators import decoding, matching, reports
from spanforge.sources import readers

GOLD, PRED = "doc_id long, gi long, s long, e long, label long", "doc_id long, pi long, s long, e long, label long"


def plain_width(s):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def plain_cut(s, w):
    s = " ".join(s.split())
    if plain_width(s) <= w:
        return s
    out, used = "", 0
    for c in s:
        if used + plain_width(c) > w - 1:
            break
        out, used = out + c, used + plain_width(c)
    return out + "…"


TEXTS = ["", " ", "abc", "  김민수\n 서울 \t주소\x1c끝 ", "😀 ab 漢字かな", "a" * 50, "é　b", "\\ \r\n\x01\x7f"]


def test_display(spark):
    d = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    got = d.select("t", display.one_line("t").alias("line"), display.display_width("t").alias("w"), display.padded("t", 8).alias("p"), display.clipped("t", 5).alias("c"), *(display.cut("t", w).alias(f"cut{w}") for w in (1, 5, 8)), *(display.escaped("t", n).alias(f"e{n}") for n in (2, 9, 100))).collect()
    for r in got:
        if r["t"] is None:
            assert all(x is None for x in r)
            continue
        t = r["t"]
        e = t.encode("unicode_escape").decode()
        assert r["line"] == " ".join(t.split()) and r["w"] == plain_width(t) and r["p"] == t + " " * max(0, 8 - plain_width(t))
        assert r["c"] == (t if len(t) <= 5 else t[:4] + "…")
        assert [r[f"cut{w}"] for w in (1, 5, 8)] == [plain_cut(t, w) for w in (1, 5, 8)]
        assert [r[f"e{n}"] for n in (2, 9, 100)] == [e if len(e) <= n else e[:n] if n <= 3 else e[: n - 3] + "..." for n in (2, 9, 100)]


def test_layers(spark):
    gold = spark.createDataFrame([(1, 0, 0, 10, 0), (1, 1, 20, 24, 2), (2, 0, 0, 4, 1)], GOLD)
    model = spark.createDataFrame([(1, 0, 0, 6, 0), (1, 1, 20, 24, 2), (1, 2, 20, 24, 2)], PRED)
    rules = spark.createDataFrame([(1, 0, 4, 10, 5)], PRED)
    rows = {r["layer"]: r for r in reports.layer_totals(gold, model, rules, (0, 1)).collect()}
    assert {k: (r["n_pred"], r["hit"], r["docs_missed"], r["rescued"], r["fp"], r["identifiers_missed"]) for k, r in rows.items()} == {
        "model": (2, 1, 2, 0, 0, 2), "rule": (1, 0, 2, 0, 0, 2), "union": (2, 2, 1, 1, 0, 1), "wider": (2, 1, 2, 0, 0, 2)}
    spans = {(r["layer"], r["s"], r["e"], r["label"]) for r in reports.layer_spans(model, rules).collect()}
    assert ("union", 0, 10, "0+5") in spans and ("wider", 0, 6, "0") in spans
    none = reports.layer_totals(gold, model.limit(0), rules.limit(0), (0, 1)).collect()
    assert len(none) == 4 and all((r["hit"], r["n_pred"], r["fp"]) == (0, 0, 0) for r in none)


def test_rollup_counts_absent_labels(spark):
    gold, pred = spark.createDataFrame([(1, 0, 0, 5, 0)], GOLD), spark.createDataFrame([(1, 0, 0, 9, 3)], PRED)
    rows = {r["label"]: r for r in reports.identifier_rollup(gold, pred, (0, 1), allowance=0).collect()}
    assert (rows[0]["fn"], rows[0]["uncovered"], rows[1]["n_gold"]) == (1, 0, 0)
    assert (rows[-1]["verdict"], rows[-1]["kept_verdict"], rows[0]["verdict"]) == ("fail", "pass", None)


def test_illegally_opened(spark):
    tags = [("B-x", 0, 2), ("I-x", 2, 4), ("O", 4, 4), ("I-y", 4, 6), ("S-x", 6, 8), ("E-x", 8, 9), ("B-x", 9, 10), ("B-x", 10, 11)]
    t = spark.createDataFrame([(1, i, s, e, tag) for i, (tag, s, e) in enumerate(tags)], "doc_id long, ti long, s long, e long, tag string")
    got = [tuple(r)[1:] for r in reports.illegally_opened(t).orderBy("si").collect()]
    assert got == [(0, 0, "x", False), (1, 4, "y", True), (2, 6, "x", True), (3, 8, "x", True), (4, 9, "x", False), (5, 10, "x", True)]


def test_two_names(spark):
    gold = spark.createDataFrame([(1, 0, 0, 5, 7, 9), (1, 1, 5, 9, 7, None)], GOLD + ", model_label long")
    pred = spark.createDataFrame([(1, 0, 0, 5, 9), (1, 1, 5, 9, 9)], PRED)
    assert {(r["gi"], r["same_label"]) for r in reports.two_names(gold, pred).collect()} == {(0, True), (1, False)}


def test_owner_of_overmasked(spark):
    gold = spark.createDataFrame([(1, 0, 2, 4, 1), (1, 1, 6, 8, 2)], GOLD)
    pred = spark.createDataFrame([(1, 0, 0, 8, 5), (1, 1, 7, 12, 5), (1, 2, 20, 23, 2), (1, 3, 30, 31, 5)], PRED)
    got = {r["owner"]: (r["over_chars"], r["n"]) for r in reports.overmask_by_owner(gold, pred).collect()}
    assert got == {1: (4, 1), 2: (4 + 3, 2), -1: (1, 1)}


def test_probe_records(spark, tmp_path):
    p = tmp_path / "probes.jsonl"
    lines = [{"text": "call 010 now", "spans": {"phone: 010": [[5, 8]], "who: now": [[9, 12]]}, "info": {"id": "a", "corp_category": "연락처", "probe_type": "P1"}}, {"spans": {}}, {"text": "x", "spans": {"n: x": [[0, 1]]}}]
    p.write_text("\n".join([json.dumps(lines[0], ensure_ascii=False), "not json", "", *map(json.dumps, lines[1:])]))
    got = {r["id"]: r for r in readers.read_probes(spark, str(p)).collect()}
    assert len(got) == 2 and got["a"]["probe_type"] == "P1"
    assert [tuple(x) for x in got["a"]["spans"]] == [(5, 8, "010", "연락처", "phone"), (9, 12, "now", "연락처", "who")]
    other = next(r for k, r in got.items() if k.startswith("PROBE-"))
    assert [tuple(x) for x in other["spans"]] == [(0, 1, "x", "n", "n")] and other["probe_type"] == "?"
    p.write_text("")
    with pytest.raises(readers.InputError):
        readers.read_probes(spark, str(p))


def test_cached_scores(spark, tmp_path):
    x = np.arange(66, dtype="float32").reshape(2, 33)
    np.savez(tmp_path / "s.npz", a=x, b=x[:0])
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"doc_id": k, "text": "ab", "offsets": [[0, 1], [1, 2]]}) for k in "abc"))
    got = {r["doc_id"]: r for r in readers.read_scores(spark, str(tmp_path / "s.npz"), str(tmp_path / "m.jsonl")).collect()}
    assert np.array_equal(np.array(got["a"]["scores"], dtype="float32"), x) and got["b"]["scores"] == [] and got["c"]["scores"] is None
    assert [list(o) for o in got["a"]["offsets"]] == [[0, 1], [1, 2]]


def test_first_documents(spark):
    d = spark.range(100).select(F.col("id").alias("ord"), (100 - F.col("id")).alias("x")).repartition(7)
    assert [r["ord"] for r in readers.first_documents(d, 3).collect()] == [0, 1, 2]


def test_paths_side_by_side(monkeypatch):
    tags = decoding.classes(["x", "y"])
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, (n, len(tags))) / 2.0 for n in (3, 0, 1, 7, 7, 2, 40, 5)]
    alone = [decoding.best_path(x, tags, {"end_to_start": -0.5}) for x in texts]
    for cells in (1, 200, 10_000):
        monkeypatch.setattr(decoding, "CELLS", cells)
        assert decoding.best_paths(texts, tags, {"end_to_start": -0.5}) == alone


def test_greedy_by_clusters(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(int(d), i, int(s), int(s + w), int(x)) for i, (d, s, w, x) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 200, n), rng.integers(1, 12, n), rng.integers(0, 3, n)))]
    gold, pred = make(120), make(120)
    cand = sorted((-(min(g[3], p[3]) - max(g[2], p[2])), g[2], p[2], g[1], p[1], g[0], g[4] == p[4]) for g in gold for p in pred if g[0] == p[0] and g[2] < p[3] and p[2] < g[3])
    for criterion in ("type", "partial"):
        left, right, want = set(), set(), set()
        for _, _, _, gi, pi, d, same in cand:
            if (same or criterion == "type") and gi not in left and pi not in right:
                left.add(gi), right.add(pi), want.add((d, gi, pi))
        g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)
        assert {tuple(r) for r in matching.greedy(matching.candidates(g, p), criterion).collect()} == want
