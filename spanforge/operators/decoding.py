"""Tags and spans: three dialects of reading BIOES tags, illegal transitions, constrained Viterbi.

Tokens are ``tokens(doc_id, ti, s, e, tag)``, tags ``O`` or ``B-x``, ``I-x``, ``E-x``, ``S-x``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_PARTS = "split_part(tag, '-', 1) AS pre, CASE WHEN position('-' IN tag) > 0 THEN substr(tag, position('-' IN tag) + 1) ELSE '' END AS lab"

#: Breaks of the rules, counted in token order: start, transitions, end.
ILLEGAL = f"""
SELECT doc_id, cast(sum(bad + bad_end) AS bigint) AS n_illegal FROM (
  SELECT doc_id,
    CASE WHEN pp IS NULL THEN CASE WHEN pre IN ('O', 'B', 'S') THEN 0 ELSE 1 END
         WHEN pp IN ('O', 'E', 'S') THEN CASE WHEN pre IN ('O', 'B', 'S') THEN 0 ELSE 1 END
         ELSE CASE WHEN pre IN ('I', 'E') AND lab = pl THEN 0 ELSE 1 END END AS bad,
    CASE WHEN nx IS NULL AND pre NOT IN ('O', 'E', 'S') THEN 1 ELSE 0 END AS bad_end
  FROM (SELECT *, lag(pre) OVER (PARTITION BY doc_id ORDER BY ti) AS pp, lag(lab) OVER (PARTITION BY doc_id ORDER BY ti) AS pl, lead(ti) OVER (PARTITION BY doc_id ORDER BY ti) AS nx
        FROM (SELECT *, {_PARTS} FROM {{tokens}}) a) b) c GROUP BY doc_id"""

#: Any inside or end without an opener opens a span; tokens of no width are skipped. ``{{only}}`` keeps closed spans alone.
LENIENT = f"""
SELECT doc_id, max(lab) AS label, min(s) AS s, max(e) AS e FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY ti) AS first, row_number() OVER (PARTITION BY doc_id, island ORDER BY ti DESC) AS last FROM (
    SELECT *, sum(CASE WHEN pre IN ('O', 'B', 'S') OR pp IS NULL OR pp IN ('O', 'E', 'S') OR pl <> lab THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ti ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, lag(pre) OVER (PARTITION BY doc_id ORDER BY ti) AS pp, lag(lab) OVER (PARTITION BY doc_id ORDER BY ti) AS pl FROM (SELECT *, {_PARTS} FROM {{tokens}} WHERE s <> e) a) b) c WHERE pre <> 'O') d
GROUP BY doc_id, island"""

STRICT = LENIENT + """
HAVING max(CASE WHEN first = 1 THEN pre END) = 'S' OR (max(CASE WHEN first = 1 THEN pre END) = 'B' AND max(CASE WHEN last = 1 THEN pre END) = 'E')"""

#: Pairs of tags that may follow each other.
LEGAL = """CASE WHEN pa IN ('O', 'E', 'S') THEN pb IN ('O', 'B', 'S') ELSE pb IN ('I', 'E') AND la = lb END"""


def illegal(tokens: DataFrame) -> DataFrame:
    return tokens.sparkSession.sql(ILLEGAL, tokens=tokens)


def spans_lenient(tokens: DataFrame) -> DataFrame:
    return tokens.sparkSession.sql(LENIENT, tokens=tokens)


def spans_strict(tokens: DataFrame) -> DataFrame:
    return tokens.sparkSession.sql(STRICT, tokens=tokens)


def spans_by_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, label, first, last) in token numbers: a gap in ``ti`` closes a span, an end without
    an opener is a span of one token, an inside without one opens, and what is open at the end is given out.

    A fold over the ordered tokens, as each step depends on the open span.
    """
    fold = """aggregate(array_sort(collect_list(named_struct('ti', cast(ti AS bigint), 'pre', split_part(tag, '-', 1), 'lab', if(instr(tag, '-') > 0, substr(tag, instr(tag, '-') + 1), '')))),
      named_struct('out', cast(array() AS array<struct<label:string,first:bigint,last:bigint>>), 'lab', cast(null AS string), 'first', -1L, 'last', -1L),
      (a, x) -> CASE
        WHEN x.pre IN ('I', 'E') AND a.lab = x.lab AND x.ti = a.last + 1 THEN
          if(x.pre = 'I', named_struct('out', a.out, 'lab', a.lab, 'first', a.first, 'last', x.ti),
             named_struct('out', array_append(a.out, named_struct('label', a.lab, 'first', a.first, 'last', x.ti)), 'lab', cast(null AS string), 'first', -1L, 'last', -1L))
        WHEN x.pre IN ('B', 'I') THEN named_struct('out', if(a.lab IS NULL, a.out, array_append(a.out, named_struct('label', a.lab, 'first', a.first, 'last', a.last))), 'lab', x.lab, 'first', x.ti, 'last', x.ti)
        WHEN x.pre IN ('S', 'E') THEN named_struct('out', array_append(if(a.lab IS NULL, a.out, array_append(a.out, named_struct('label', a.lab, 'first', a.first, 'last', a.last))), named_struct('label', x.lab, 'first', x.ti, 'last', x.ti)), 'lab', cast(null AS string), 'first', -1L, 'last', -1L)
        ELSE named_struct('out', if(a.lab IS NULL, a.out, array_append(a.out, named_struct('label', a.lab, 'first', a.first, 'last', a.last))), 'lab', cast(null AS string), 'first', -1L, 'last', -1L) END,
      a -> if(a.lab IS NULL, a.out, array_append(a.out, named_struct('label', a.lab, 'first', a.first, 'last', a.last))))"""
    return tokens.sparkSession.sql(f"SELECT doc_id, inline(spans) FROM (SELECT doc_id, {fold} AS spans FROM {{tokens}} GROUP BY doc_id) x", tokens=tokens)


#: BIOES tags of tokens from character spans; ``{class}`` is the label column or one name for all.
TAGS_OF = """
WITH best AS (SELECT * FROM (SELECT t.doc_id, t.ti, p.si, p.label, row_number() OVER (PARTITION BY t.doc_id, t.ti ORDER BY least(t.e, p.e) - greatest(t.s, p.s) DESC, p.si) AS rn
              FROM {tokens} t JOIN {spans} p ON t.doc_id = p.doc_id AND t.s < p.e AND p.s < t.e) x WHERE rn = 1),
     m AS (SELECT t.doc_id, t.ti, b.label, b.si IS NOT NULL AS inside, lag(b.si) OVER w IS DISTINCT FROM b.si AS opens, lead(b.si) OVER w IS DISTINCT FROM b.si AS closes
           FROM {tokens} t LEFT JOIN best b ON b.doc_id = t.doc_id AND b.ti = t.ti WINDOW w AS (PARTITION BY t.doc_id ORDER BY t.ti))
SELECT doc_id, ti, CASE WHEN NOT inside THEN 'O' ELSE concat(CASE WHEN opens AND closes THEN 'S' WHEN opens THEN 'B' WHEN closes THEN 'E' ELSE 'I' END, '-', {class}) END AS tag FROM m"""


def tags_of(tokens: DataFrame, spans: DataFrame, typed: bool = True, only: str = "span") -> DataFrame:
    """BIOES tags of tokens from character spans: each token goes to the span it overlaps most (earliest on ties); untyped gives all one class."""
    return tokens.sparkSession.sql(TAGS_OF.replace("{class}", "label" if typed else f"'{only}'"), tokens=tokens, spans=spans)


def classes(labels: list[str]) -> list[str]:
    return ["O", *(f"{p}-{x}" for x in labels for p in "BIES")]


BIASES = ("background_stay", "background_to_start", "end_to_background", "end_to_start", "inside_to_continue", "inside_to_end")


def transitions(tags: list[str], biases: dict[str, float] | None = None):
    """(legal, bias) matrices, and which classes may begin and end a text."""
    import numpy as np

    b = dict.fromkeys(BIASES, 0.0) | (biases or {})
    pre, lab = [t.split("-", 1)[0] for t in tags], [t.split("-", 1)[1] if "-" in t else "" for t in tags]
    n = len(tags)
    legal, bias = np.zeros((n, n), bool), np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if pre[i] in "OES":
                legal[i, j] = pre[j] in "OBS"
                key = ("background_stay" if pre[j] == "O" else "background_to_start") if pre[i] == "O" else ("end_to_background" if pre[j] == "O" else "end_to_start")
            else:
                legal[i, j] = pre[j] in "IE" and lab[i] == lab[j]
                key = "inside_to_continue" if pre[j] == "I" else "inside_to_end"
            bias[i, j] = b[key]
    return legal, bias, np.array([p in "OBS" for p in pre]), np.array([p in "OES" for p in pre])


FORBIDDEN = -1e9


def best_path(scores, tags: list[str], biases: dict[str, float] | None = None) -> tuple[list[int], float]:
    """Best legal classes of one text (log-softmax first; ties to the lowest class); argmax where nothing is legal."""
    return best_paths([scores], tags, biases)[0]


#: Scores that are decoded side by side, at most, where one text alone has not more.
CELLS = 2_000_000


def best_paths(texts: list, tags: list[str], biases: dict[str, float] | None = None) -> list[tuple[list[int], float]]:
    """``best_path`` of many texts: texts of like lengths go through the tokens together, the longest first, so that those
    still running are the first rows of the block."""
    import numpy as np

    legal, bias, may_start, may_end = transitions(tags, biases)
    move, begin, end = np.where(legal, bias, FORBIDDEN), np.where(may_start, 0.0, FORBIDDEN), np.where(may_end, 0.0, FORBIDDEN)
    n, out = len(tags), [([], 0.0)] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        block = order[at : at + max(1, CELLS // (longest * n))]
        at += len(block)
        lengths = np.array([len(texts[i]) for i in block])
        x = np.zeros((len(block), longest, n))
        for k, i in enumerate(block):
            x[k, : lengths[k]] = np.asarray(texts[i], float)
        x -= x.max(2, keepdims=True)
        x -= np.log(np.exp(x).sum(2, keepdims=True))
        score = x[:, 0] + begin
        back = np.zeros(x.shape, np.int16 if n < 32_000 else np.int64)
        for t in range(1, longest):
            live = int((lengths > t).sum())
            total = score[:live, :, None] + move
            back[:live, t] = best = total.argmax(1)
            score[:live] = np.take_along_axis(total, best[:, None, :], 1)[:, 0] + x[:live, t]
        score += end
        for k, i in enumerate(block):
            m = lengths[k]
            if score[k].max() <= FORBIDDEN / 2:
                out[i] = (x[k, :m].argmax(1).tolist(), float(x[k, :m].max(1).sum()))
                continue
            path = [int(score[k].argmax())]
            for t in range(m - 1, 0, -1):
                path.append(int(back[k, t, path[-1]]))
            out[i] = (path[::-1], float(score[k].max()))
    return out


def viterbi(scores: DataFrame, labels: list[str], biases: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, argmax, viterbi, score) of ``scores(doc_id, logits array<array<double>>)``: both decodings from one scan, the texts of an Arrow batch side by side."""
    tags = classes(labels)

    def run(batches):
        import numpy as np
        import pandas as pd

        for df in batches:
            texts = [np.stack(x) if len(x) else x for x in df["logits"]]
            paths = best_paths(texts, tags, biases)
            first = [[tags[i] for i in x.argmax(1)] if len(x) else [] for x in texts]
            yield pd.DataFrame({"doc_id": df["doc_id"], "argmax": first, "viterbi": [[tags[i] for i in p] for p, _ in paths], "score": [s for _, s in paths]})

    return scores.select("doc_id", "logits").mapInPandas(run, "doc_id long, argmax array<string>, viterbi array<string>, score double")
