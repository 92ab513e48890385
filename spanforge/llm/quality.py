"""Line-first quality cleaning, in DataFrame expressions only.

Each line is judged by itself: boilerplate phrases in a short line, navigation (separators between
few words), symbols for text, prose without sentence punctuation. Failing lines go; a document is
rejected if less than half of its word characters is left. Lines without a word always stay.

Before that, whole-document base rules: fewer than ``MIN_WORDS`` words, or over 30 percent of the
words inside 8-word windows that occur twice or more. Window hashes are compared inside the row, by
sorting, so that nothing is shuffled and the cost is n log n in the length of one text.

A null text has no words: all counts 0, ``base_failed``, not kept; its cleaned text stays null.
Repeated rows and null ids each keep their row. An empty table gives no rows. Columns of the input
come back only where asked for (``clean``); clashing names cannot occur, as working columns are
prefixed ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, MIN_LEFT_PERCENT = 20, 8, 30, 50
#: Both Java and RE2 read these alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
BOILERPLATE = (
    r"\b(all rights reserved|copyright|licensed? under|license|licence|terms of (use|service)|privacy policy|accept cookies|cookie (policy|settings)"
    r"|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|enable javascript|lorem ipsum)\b"
)
SENTENCE_END = r"[.!?…。！？][\"')\]”»’]*([\x20\x09-\x0D]|$)"
SEPARATORS, SYMBOLS = "|»›•·", "#*$%&|<>"
#: A boilerplate line has at most so many words; a line needs a sentence end among so many.
SHORT_LINE, SENTENCE_WORDS, PLAIN_LINE = 40, 50, 8

#: What ``BOILERPLATE`` says, asked only where a word begins with a letter that one of its phrases begins with.
_BOILERPLATE = BOILERPLATE.replace(r"\b(", r"\b(?=[aceln-pr-t])(", 1)
_END = SENTENCE_END.replace('"', r"\x22")


def _less(text: str, gone: str) -> str:
    """Bytes of ``text`` that removing ``gone`` everywhere takes away."""
    return f"(octet_length({text}) - octet_length(replace({text}, {gone}, '')))"


def _separators(text: str) -> str:
    """How many separators ``text`` has: one pass for each, faster than a class that reaches beyond ASCII."""
    return "(" + " + ".join(f"{_less(text, repr(c))} div {len(c.encode())}" for c in SEPARATORS) + ")"


#: Of line ``l``, read as ``n`` where every blank is a space: blanks.
_LINES = f"""zip_with(split(_q_text, '\\n', -1), split(_q_norm, '\\n', -1), (l, n) -> named_struct('l', l, 'n', n, 'blanks', {_less('n', "' '")}))"""
#: Words of a line; lines without two spaces in a row need no split.
_COUNTED = """transform(_q_lines, s -> named_struct('l', s.l, 'n', s.n, 'chars', length(s.n) - s.blanks, 'words',
    CASE WHEN s.n = '' THEN 0
         WHEN contains(s.n, '  ') THEN size(array_remove(split(s.n, ' ', -1), ''))
         ELSE s.blanks + 1 - int(startswith(s.n, ' ')) - int(endswith(s.n, ' ')) END))"""
#: Whether a line stays. A text without separators or symbols has no line with them, and each full
#: stop before a blank is a sentence end of its own: where those are enough, no pattern is run.
_STAYS = rf"""transform(array(named_struct('separators', _q_n_separators, 'symbols', _q_n_symbols)), z -> transform(_q_counted, s -> named_struct('l', s.l, 'chars', s.chars, 'words', s.words, 'stays',
    s.words = 0 OR NOT (
      (z.separators >= 3 AND {_separators('s.l')} >= greatest(3, s.words / 5))
      OR (z.symbols > 0 AND 10 * length(regexp_replace(s.l, r'[^{SYMBOLS}]+', '')) > length(s.l))
      OR (s.words >= {PLAIN_LINE} AND {SENTENCE_WORDS} * ({_less('s.n', "'. '")} div 2) < s.words
          AND {SENTENCE_WORDS} * regexp_count(s.l, r"{_END}") < s.words)
      OR (s.words <= {SHORT_LINE} AND lower(s.l) RLIKE r'{_BOILERPLATE}')))))[0]"""


def _steps(array: str, by: int) -> str:
    """Hashes of each element with the one ``by`` behind it."""
    return f"zip_with(slice({array}, 1, greatest(size({array}) - {by}, 0)), slice({array}, {by + 1}, greatest(size({array}) - {by}, 0)), (a, b) -> xxhash64(a, b))"


#: Words covered by windows that occur twice or more, from hashes of their halves: only where a half
#: occurs twice are windows hashed, and only where a window does are they sorted with their places,
#: so that equal neighbours stay and the union of their windows is measured.
REPEATED = f"""
CASE WHEN size(_q_halves) <= {WINDOW // 2} OR size(array_distinct(_q_halves)) = size(_q_halves) THEN 0L ELSE
  transform(array({_steps('_q_halves', WINDOW // 2)}), w -> CASE WHEN size(array_distinct(w)) = size(w) THEN 0L ELSE
    transform(array(sort_array(transform(w, (h, i) -> named_struct('h', h, 'i', i)))), s ->
      aggregate(
        sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i)),
        named_struct('n', 0L, 'end', 0L),
        (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.end, cast(p AS bigint)), 'end', cast(p AS bigint) + {WINDOW}),
        a -> a.n))[0] END)[0]
END"""


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_n_words``, ``_q_word_chars``, ``_q_n_symbols``, ``_q_n_dup_lines``, ``_q_n_repeat_words``, ``_q_base_failed``, ``_q_cleaned``, ``_q_kept``.

    Every blank becomes a space first, so that words are split and counted at one character. No
    lambda reads a computed column but as its array: the optimizer may move the column's expression
    into the lambda, where it would be evaluated for every element.
    """
    blanks = "_q_text"
    for c in (9, 11, 12, 13):
        blanks = f"replace({blanks}, chr({c}), ' ')"
    return (
        docs.withColumn("_q_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("_q_norm", F.expr(blanks))
        .withColumns(
            {
                "_q_pieces": F.expr("split(replace(_q_norm, chr(10), ' '), ' ', -1)"),  # one more than blanks
                "_q_lines": F.expr(_LINES),
            }
        )
        .withColumns(
            {
                "_q_words": F.expr("array_remove(_q_pieces, '')"),
                "_q_n_symbols": F.expr(f"cast(length(regexp_replace(_q_text, r'[^{SYMBOLS}]+', '')) AS bigint)"),
                "_q_n_separators": F.expr(_separators("_q_text")),
                "_q_word_chars": F.expr("cast(length(_q_text) - size(_q_pieces) + 1 AS bigint)"),
                "_q_counted": F.expr(_COUNTED),
            }
        )
        .withColumns({"_q_pairs": F.expr(_steps("_q_words", 1)), "_q_judged": F.expr(_STAYS), "_q_n_words": F.expr("cast(size(_q_words) AS bigint)")})
        .withColumns(
            {
                "_q_halves": F.expr(_steps("_q_pairs", 2)),
                "_q_full_lines": F.expr("transform(filter(_q_judged, s -> s.words > 0), s -> s.l)"),
                "_q_stay": F.expr("filter(_q_judged, s -> s.stays)"),
            }
        )
        .withColumns(
            {
                "_q_cleaned": F.expr("array_join(transform(_q_stay, s -> s.l), '\\n')"),
                "_q_left": F.expr("aggregate(_q_stay, 0L, (a, s) -> a + s.chars)"),
                "_q_n_dup_lines": F.expr("cast(size(_q_full_lines) - size(array_distinct(_q_full_lines)) AS bigint)"),
                "_q_n_repeat_words": F.expr(REPEATED),
            }
        )
        .withColumn("_q_base_failed", F.expr(f"_q_n_words < {MIN_WORDS} OR 100 * _q_n_repeat_words > {MAX_REPEAT_PERCENT} * _q_n_words"))
        .withColumn("_q_kept", F.expr(f"NOT _q_base_failed AND 100 * _q_left >= {MIN_LEFT_PERCENT} * _q_word_chars"))
    )


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *(F.col(f"_q_{n}").alias(n) for n in names))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their columns, failed lines removed from ``text``; ``n_chars``, if there, follows."""
    # a filter right above would be pushed down with all its expressions inlined, and each evaluated again for every element of the arrays inside
    kept = judged(docs).withColumn("_q_row", F.monotonically_increasing_id()).filter("_q_kept AND _q_row >= 0")
    new = {"text": F.col("_q_cleaned"), "n_chars": F.length("_q_cleaned").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def oracle() -> str:
    """DuckDB SQL for ``rules``."""
    stays = rf"""
      len(regexp_extract_all(l, '{WORD}')) = 0 OR NOT (
        (len(regexp_extract_all(l, '{WORD}')) <= {SHORT_LINE} AND regexp_matches(lower(l), '{BOILERPLATE}'))
        OR (len(regexp_extract_all(l, '[{SEPARATORS}]')) >= 3 AND 5 * len(regexp_extract_all(l, '[{SEPARATORS}]')) >= len(regexp_extract_all(l, '{WORD}')))
        OR 10 * len(regexp_extract_all(l, '[{SYMBOLS}]')) > length(l)
        OR (len(regexp_extract_all(l, '{WORD}')) >= {PLAIN_LINE} AND {SENTENCE_WORDS} * len(regexp_extract_all(l, '{SENTENCE_END.replace("'", "''")}')) < len(regexp_extract_all(l, '{WORD}'))))"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
     p AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
     g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM p),
     c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
     m AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM c WHERE n > 1),
     u AS (SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM m GROUP BY r),
     x AS (SELECT w.r, doc_id, t, len(ws) AS nw, list_filter(ls, lambda l: regexp_matches(l, '{WORD}')) AS fl, coalesce(u.n, 0) AS nr,
                  array_to_string(list_filter(ls, lambda l: {stays}), chr(10)) AS cl
           FROM w LEFT JOIN u ON u.r = w.r),
     y AS (SELECT *, nw < {MIN_WORDS} OR 100 * nr > {MAX_REPEAT_PERCENT} * nw AS bf, length(regexp_replace(t, '{SPACES}', '', 'g')) AS wc FROM x)
SELECT doc_id, nw::BIGINT AS n_words, wc::BIGINT AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
       (len(fl) - len(list_distinct(fl)))::BIGINT AS n_dup_lines, nr::BIGINT AS n_repeat_words, bf AS base_failed,
       NOT bf AND 100 * length(regexp_replace(cl, '{SPACES}', '', 'g')) >= {MIN_LEFT_PERCENT} * wc AS kept
FROM y"""
