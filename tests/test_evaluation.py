"""Rewrites, token ranges and scores against plain Python; the evaluation and command line end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge import functions as fn
from spanforge.__main__ import main
from spanforge.api import Redactor
from spanforge.operators import rewrites, scoring
from spanforge.plans import evaluation
from spanforge.sources import sinks


def rewritten(text, spans, phrases):
    for old, new in phrases.items():
        at = 0
        while (i := text.find(old, at)) >= 0 and not any(s < i + len(old) and i < e for s, e, _ in spans):
            text, d = text[:i] + new + text[i + len(old) :], len(new) - len(old)
            spans = [(s + d, e + d, x) if s >= i + len(old) else (s, e, x) for s, e, x in spans]
            at = i + len(new)
    return text, spans


def test_carriers(spark):
    rng, rows = random.Random(3), []
    for i in range(150):
        text = "".join(rng.choice(["a.b", "x", " ", "é", "\\E", "zz"]) for _ in range(rng.randrange(25)))
        cuts = sorted(rng.sample(range(len(text) + 1), 4)) if len(text) > 4 else []
        rows.append((i, text, [(s, e, "n") for s, e in zip(cuts[::2], cuts[1::2]) if s < e], i))
    phrases = {"a.b": "c", "zz": "yyyy", "\\E": "q", "é": ""}
    df = spark.createDataFrame([*rows, (998, None, [], 0), (999, "a.b zz", None, 0)], f"doc_id long, text string, spans {fn.SPANS}, _other int")
    out = rewrites.carriers_rewritten(df, phrases)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans] if r.spans is not None else None) for r in out.collect()}
    for i, text, spans, _ in rows:
        assert got[i] == rewritten(text, spans, phrases), (text, spans)
    assert got[998] == (None, []) and got[999] == ("c yyyy", None)
    with pytest.raises(ValueError):
        rewrites.carriers_rewritten(df, {"": "x"})


def test_variants(spark):
    values = ["010-1234-5678", "M12345678", "1 2", "1234", "", None, "a.b-c d"]
    df = spark.createDataFrame([(v, n) for v in values for n in range(30)], "v string, n int")
    out = df.select("v", rewrites.cut_short("v", 1, "n").alias("cut"), rewrites.cut_short("v", 1, "n", words=True).alias("words"), rewrites.spoken("v", 2, "n").alias("spoken"), rewrites.respaced("v", 3, "n").alias("spaced")).collect()
    for v, cut, words, spoken, spaced in out:
        if v is None:
            assert cut is words is spoken is spaced is None
            continue
        assert v.startswith(cut) and (cut == v if len(v) <= 4 else 4 <= len(cut) < len(v))
        parts = v.split(" ")
        assert v.startswith(words) and (words == v if len(parts) == 1 else words.split(" ") == parts[: len(words.split(" "))] and words != v)
        bare = [c for c in v if c not in "- ."]
        assert [c for c in spaced if c not in "- ."] == bare and [c for c in spoken if c in bare] == bare
        assert (spoken == v) if not set(v) & set("- .") else spoken in [j.join(p for p in v.replace("-", " ").replace(".", " ").split(" ") if p) for j in rewrites.SPOKEN]
        if v == "M12345678":
            assert len(spaced) == 10 and 2 <= spaced.index(" ") <= 7
    assert len({r.spaced for r in out if r.v == "010-1234-5678"}) > 3


def test_token_ranges(spark):
    rng = random.Random(5)
    texts = ["", "aé한😀b", "".join(rng.choice("aé한😀 ") for _ in range(40)), None]
    cut = lambda t: [t.encode()[i : i + 3] for i in range(0, len(t.encode()), 3)]
    for t in filter(None, texts):
        starts, ends, at, b = *scoring.char_ranges(t, cut(t)), [], 0
        for c in t:
            at.append((b, b + len(c.encode())))
            b += len(c.encode())
        for j, (s, e) in enumerate(zip(starts, ends, strict=True)):
            assert list(range(s, e)) == [i for i, (x, y) in enumerate(at) if x < 3 * j + len(cut(t)[j]) and 3 * j < y]
    assert scoring.char_ranges("ab", [b"a"]) == ([0], [1]) and scoring.char_ranges("ab", [b"", b"ab"]) == ([0, 0], [0, 2])
    with pytest.raises(ValueError):
        scoring.char_ranges("ab", [b"b"])

    def load():
        return lambda ts: [[(len(p), p) for p in (t.encode()[i : i + 3] for i in range(0, len(t.encode()), 3))] for t in ts]

    def model():
        def score(windows):
            assert all(0 < len(w) <= 4 for w in windows)
            return [[[float(i), float(j)] for j, i in enumerate(w)] for w in windows]

        return score

    tokens = scoring.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), load)
    ids = {r.doc_id: list(r.ids) for r in tokens.collect()}
    got = {r.doc_id: [list(x) for x in r.logits] for r in scoring.scored(tokens, model, 4, 2).collect()}
    assert got == {d: [[float(i), float(j % 4)] for j, i in enumerate(x)] for d, x in ids.items()} and ids[0] == ids[3] == []


def test_uncovered(spark):
    rng = random.Random(7)
    some = lambda: [(s, s + rng.randrange(1, 6), "x") for s in (rng.randrange(20) for _ in range(rng.randrange(5)))]
    rows = [(i, some(), some()) for i in range(100)]
    out = spark.createDataFrame(rows, f"i int, a {fn.SPANS}, b {fn.SPANS}").select("i", fn.uncovered("a", "b").alias("u")).collect()
    chars = lambda spans: {c for s, e, _ in spans for c in range(s, e)}
    for i, u in out:
        assert chars(u) == chars(rows[i][1]) - chars(rows[i][2])
        assert all(x.end < y.start or chars(rows[i][2]) & {x.end} for x, y in zip(u, u[1:]))


def test_redactor(spark):
    text = "Mail to ann@mail.org, from 10.0.0.1"
    r = Redactor().redact(spark, text)
    assert r["redacted_text"] == "Mail to <EMAIL>, from <QUAD>" and r["summary"] == {"span_count": 2, "by_label": {"email": 1, "quad": 1}, "output_mode": "typed"}
    assert r["detected_spans"][0] == {"label": "email", "start": 8, "end": 20, "text": "ann@mail.org"}
    assert Redactor().with_(mode="redacted").redact(spark, text)["redacted_text"] == "Mail to <REDACTED>, from <REDACTED>"
    with pytest.raises(ValueError):
        Redactor("loud")


def test_command_line(spark, tmp_path, capsys):
    main(["redact", "to ann@mail.org", " "], spark)
    assert [json.loads(x)["redacted_text"] for x in capsys.readouterr().out.splitlines()] == ["to <EMAIL>"]
    span = lambda s, e, c: {"start": s, "end": e, "value": "x", "corp_category": c}
    gold = [{"id": "1", "text": "Ann Lee lives", "spans": [span(0, 7, "name")]}, {"id": "2", "text": "no. 12345", "spans": [span(4, 9, "id")]}]
    (tmp_path / "gold.json").write_text(json.dumps({"documents": gold}))
    lines = [{"text": "Ann Lee lives", "spans": [{"start": 0, "end": 3, "label": "name"}, {"start": 8, "end": 99, "label": "name"}]}, {"text": "no. 12345", "spans": []}]
    (tmp_path / "pred.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    main(["eval", str(tmp_path / "gold.json"), str(tmp_path / "pred.jsonl"), str(tmp_path / "out.json"), "--timings", str(tmp_path / "t.json")], spark)
    m = json.loads((tmp_path / "out.json").read_text())["metrics"]
    assert (m["overall.gold"], m["overall.tp"], m["overall.partial"], m["overall.exposed_chars"], m["overall.pred"], m["overall.fp"]) == (2, 1, 1, 4, 1, 0)
    assert m["overall.recall"] == 0.5 and m["label.id.missed_docs"] == 1 and not evaluation.broken(m)
    assert evaluation.broken(m | {"overall.tp": 2, "overall.recall": 2.0}) == ["overall.recall", "overall: matched and missed"]
    assert json.loads((tmp_path / "t.json").read_text())["timings_seconds"].keys() == {"read", "score", "overall_wall"}


def test_pool():
    base = {"surnames": ["a"], "romanization": {"surname": {"a": "A", "b": "B"}, "given": {}}, "address": {}, "email_domains": [], "note": 1}
    assert sinks.rebuilt_pool(base, {"surnames": ["b"], "extra": 2}) == base | {"surnames": ["b"], "extra": 2}
    for wrong in ({"surnames": ["c"]}, {"given": ["x"]}):
        with pytest.raises(ValueError):
            sinks.rebuilt_pool(base, wrong)
    with pytest.raises(ValueError):
        sinks.rebuilt_pool({"romanization": {}}, {})
