"""Column builders. Spans are half-open code point intervals ``struct<start int, end int, label string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string>"
SPANS = f"array<{SPAN}>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- predicates -----------------------------------------------------------------------------


def overlaps(s1, e1, s2, e2) -> Column:
    """Half-open overlap; touching intervals do not overlap."""
    return (_c(s1) < _c(e2)) & (_c(s2) < _c(e1))


def contains(outer_s, outer_e, inner_s, inner_e) -> Column:
    return (_c(outer_s) <= _c(inner_s)) & (_c(inner_e) <= _c(outer_e))


def overlap_length(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def enough_overlap(overlap, gold_length, k: int = 3) -> Column:
    """At least ``k`` shared characters, or all of a gold span shorter than that."""
    return _c(overlap) >= F.least(_c(gold_length), F.lit(k))


def ascii_only(text) -> Column:
    return ~_c(text).rlike(r"[^\x00-\x7F]")


def valid_span(start, end, text) -> Column:
    return (_c(start) >= 0) & (_c(start) < _c(end)) & (_c(end) <= F.length(_c(text)))


def span_text(text, start, end) -> Column:
    return F.substring(_c(text), _c(start) + 1, _c(end) - _c(start))


def intact(text, start, end, value) -> Column:
    """Whether the text between the offsets is the span's value."""
    return span_text(text, start, end) == _c(value)


def usable_surface(value, numeric) -> Column:
    """At least four digits where the category is numeric, else at least two characters."""
    return F.when(_c(numeric), F.regexp_count(_c(value), F.lit("[0-9]")) >= 4).otherwise(F.length(_c(value)) >= 2)


def mentions(text, words: list[str]) -> Column:
    """Whether any of the words occurs."""
    return _c(text).rlike("|".join(rf"\Q{w}\E" for w in words))


# --- scores ---------------------------------------------------------------------------------


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def f_beta(p, r, beta: float = 1.0) -> Column:
    """F of precision and recall, 0 where undefined."""
    b = beta * beta
    return ratio((1 + b) * _c(p) * _c(r), b * _c(p) + _c(r))


def token_f(tp, fp, fn, beta: float = 1.0) -> Column:
    """F from counts; null (no such metric) where the denominator is 0."""
    b = beta * beta
    return F.try_divide((1 + b) * _c(tp), (1 + b) * _c(tp) + b * _c(fn) + _c(fp))


def log_softmax(x) -> Column:
    x = _c(x)
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.ln(total))


def argmax(x) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def log_mean_exp(x) -> Column:
    """log of the mean of exponentials: several windows' scores of one token as one."""
    x = _c(x)
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))) - F.ln(F.size(x))


def top_k(labels, scores, k: int) -> Column:
    """The k best (score, label) pairs."""
    return F.slice(F.reverse(F.array_sort(F.arrays_zip(_c(scores).alias("score"), _c(labels).alias("label")))), 1, k)


# --- text and spans -------------------------------------------------------------------------


def regex_spans(text, pattern: str, label: str) -> Column:
    """All matches of a pattern as spans: offsets are running lengths of gaps and matches."""
    t = _c(text)
    matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(F.split(t, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("hit"))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + F.length(x["gap"])).cast("int").alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).cast("int").alias("end"), F.lit(label).alias("label"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(t.rlike(pattern), walked).otherwise(F.array().cast(SPANS))  # most texts have no match, and take one search


def in_order(spans) -> Column:
    """Spans by start, then end, then label."""
    return F.array_sort(_c(spans))


def replaced(text, spans, by) -> Column:
    """``text`` with disjoint spans, in order, replaced by ``by(span)``; what starts behind the cursor only counts."""
    t, s = _c(text), in_order(spans)
    end = F.aggregate(
        s,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(
            x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), by(x)).alias("out"))
        ).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return end


def typed_mask(text, spans) -> Column:
    """Each span as ``[label]``."""
    return replaced(text, spans, lambda x: F.concat(F.lit("["), x["label"], F.lit("]")))


def placeholder(label) -> Column:
    """``<LABEL>``: upper case, other characters as one underscore, ``REDACTED`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(_c(label)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("<"), F.when(clean == "", F.lit("REDACTED")).otherwise(clean), F.lit(">"))


def redacted(text, spans) -> Column:
    return replaced(text, spans, lambda x: placeholder(x["label"]))


def union_of(spans, touching: bool = True) -> Column:
    """Disjoint ordered spans with the same cover; ``touching`` merges neighbours too. Labels join with ``+``, each once."""

    def step(a, x):
        last = F.element_at(a, -1)
        meets = (x["start"] <= last["end"]) if touching else (x["start"] < last["end"])
        label = F.when(F.array_contains(F.split(last["label"], r"\+"), x["label"]), last["label"]).otherwise(F.concat_ws("+", last["label"], x["label"]))
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), label.alias("label"))
        return F.when((F.size(a) > 0) & meets, F.array_append(F.slice(a, 1, F.size(a) - 1), merged)).otherwise(F.array_append(a, x))

    ordered = F.array_sort(F.array_distinct(_c(spans)))
    safe = lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(step(a, x))
    return F.aggregate(ordered, F.array().cast(SPANS), safe)


def masked(text, spans) -> Column:
    """Each covered character as ``*``: the length stays."""
    return replaced(text, union_of(spans), lambda x: F.repeat(F.lit("*"), x["end"] - x["start"]))


def wider_wins(spans) -> Column:
    """Older merge: of two overlapping spans the first slot that overlaps keeps the strictly wider; characters can get lost."""
    ordered = F.array_sort(F.array_distinct(_c(spans)))

    def step(a, x):
        hit = F.filter(F.transform(a, lambda y, i: F.struct(i.alias("i"), y.alias("y"))), lambda z: (x["start"] < z["y"]["end"]) & (z["y"]["start"] < x["end"]))
        first = F.get(hit, 0)
        wider = (x["end"] - x["start"]) > (first["y"]["end"] - first["y"]["start"])
        return F.when(F.size(hit) == 0, F.array_append(a, x)).when(wider, F.transform(a, lambda y, i: F.when(i == first["i"], x).otherwise(y))).otherwise(a)

    return F.aggregate(ordered, F.array().cast(SPANS), step)


def _longest_first(spans, *more) -> Column:
    keyed = F.transform(_c(spans), lambda x, i: F.struct(x["start"].alias("a"), (x["start"] - x["end"]).alias("b"), *(m(x, i) for m in more), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def disjoint_by_label(spans) -> Column:
    """Per label: by start, longer first, a span stays if it meets none that stayed."""

    def step(a, x):
        clash = F.exists(a, lambda y: (y["label"] == x["label"]) & (x["start"] < y["end"]) & (y["start"] < x["end"]))
        return F.when(clash, a).otherwise(F.array_append(a, x))

    return F.array_sort(F.aggregate(_longest_first(spans), F.array().cast(SPANS), step))


def disjoint(spans) -> Column:
    """Across labels: by start, longer first, then label; a span stays if it starts at or behind the last end."""
    ordered = _longest_first(spans, lambda x, i: x["label"].alias("c"))
    return F.aggregate(ordered, F.array().cast(SPANS), lambda a, x: F.when((F.size(a) == 0) | (x["start"] >= F.get(a, F.size(a) - 1)["end"]), F.array_append(a, x)).otherwise(a))


def uncontained(spans) -> Column:
    """By start, longer first: a span inside the last that stayed goes; partial overlaps stay."""
    ordered = _longest_first(spans, lambda x, i: i.alias("c"))
    return F.aggregate(ordered, F.array().cast(SPANS), lambda a, x: F.when((F.size(a) > 0) & (x["end"] <= F.get(a, F.size(a) - 1)["end"]), a).otherwise(F.array_append(a, x)))


def trimmed(text, spans) -> Column:
    """Spans without white space at their ends, all that Unicode or U+001C to U+001F count; empty ones go."""
    value = lambda x: span_text(text, x["start"], x["end"])
    left = lambda x: F.length(value(x)) - F.length(F.regexp_replace(value(x), "(?U)^[\\s\\x1C-\\x1F]+", ""))
    right = lambda x: F.length(value(x)) - F.length(F.regexp_replace(value(x), "(?U)[\\s\\x1C-\\x1F]+$", ""))
    cut = F.transform(_c(spans), lambda x: F.struct((x["start"] + left(x)).cast("int").alias("start"), (x["end"] - right(x)).cast("int").alias("end"), x["label"].alias("label")))
    return F.filter(cut, lambda x: x["start"] < x["end"])


def by_label(spans) -> Column:
    """Counts of the labels, as a map in label order."""
    names = F.array_sort(F.array_distinct(F.transform(_c(spans), lambda x: x["label"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.size(F.filter(_c(spans), lambda x: x["label"] == n)))))


def context(text, start, end, n: int) -> Column:
    """The n characters on either side of a span, with the span."""
    a = F.greatest(F.lit(0), _c(start) - n)
    return F.substring(_c(text), a + 1, _c(end) + n - a)


def longest_run(text) -> Column:
    """Length of the longest run of digits, of Latin or of Hangul letters, separators taken out."""
    bare = F.regexp_replace(_c(text), r"""[\s\-–—_.·,/\\()\[\]{}:;'"]+""", "")
    runs = [F.transform(F.regexp_extract_all(bare, F.lit(p), F.lit(0)), F.length) for p in ("[0-9]+", "[A-Za-z]+", "[가-힣]+")]
    return F.coalesce(F.array_max(F.concat(*runs)), F.lit(0))


def still_identifiable(left_over, gold_length) -> Column:
    """Whether what a mask leaves of a value still holds a run of half its length."""
    return 2 * longest_run(left_over) >= _c(gold_length)


def changed_ranges(a, b) -> Column:
    """Ranges where two texts of one length differ."""
    n = F.length(_c(a))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(_c(a), i + 1, F.lit(1)) != F.substring(_c(b), i + 1, F.lit(1)))
    return union_of(F.transform(differs, lambda i: F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), F.lit("").alias("label"))))


def uncovered(spans, by) -> Column:
    """Ranges of ``spans`` that no span of ``by`` covers, in order; labels of touching spans join as in ``union_of``."""
    other = union_of(by)

    def cut(x):
        meets = F.filter(other, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        piece = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), x["label"].alias("label"))
        zero = F.struct(x["start"].alias("at"), F.array().cast(SPANS).alias("out"))
        step = lambda a, y: F.struct(y["end"].alias("at"), F.array_append(a["out"], piece(a["at"], y["start"])).alias("out"))
        return F.aggregate(meets, zero, step, lambda a: F.array_append(a["out"], piece(a["at"], x["end"])))

    return F.filter(F.flatten(F.transform(union_of(spans), cut)), lambda x: x["start"] < x["end"])


# --- tags -----------------------------------------------------------------------------------


def tag_part(tag) -> Column:
    """``B`` of ``B-x``; a tag without a dash is outside."""
    return F.when(_c(tag).contains("-"), F.split(_c(tag), "-", 2)[0]).otherwise(F.lit("O"))


def tag_label(tag) -> Column:
    return F.when(_c(tag).contains("-"), F.split(_c(tag), "-", 2)[1]).otherwise(F.lit(""))


# --- check digits ---------------------------------------------------------------------------


def digits_of(x) -> Column:
    """The ASCII digits of a text as an array of ints."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def luhn(x) -> Column:
    """Whether the digits of a text pass the Luhn check (at least two digits)."""
    back = F.reverse(digits_of(x))
    total = F.aggregate(
        F.transform(back, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, d: a + d
    )
    return (F.size(back) >= 2) & (total % 10 == 0)


#: Weights of the 13-digit number's check digit.
WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def resident_check(x, add: int = 0) -> Column:
    """Whether a 13-digit number carries the right check digit; ``add`` is 2 for the older foreign numbers."""
    d = digits_of(x)
    w = F.array(*(F.lit(i) for i in WEIGHTS))
    total = F.aggregate(F.zip_with(F.slice(d, 1, 12), w, lambda a, b: a * b), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return (F.size(d) == 13) & (F.get(d, F.lit(12)) == ((11 - total % 11) % 10 + add) % 10)
