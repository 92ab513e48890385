"""Secret scans: fixed patterns plus a linear-chain conditional random field.

The base kinds are ``assign``, ``access`` and ``hex`` (patterns below; leftmost, non-overlapping,
matches that fail the length test dropped). The field tags white-space separated tokens as begin,
inside or outside of a secret from their shape, their neighbours and the share of tokens with
digits in the text; Viterbi decodes it. Its spans (kind ``crf``) are added unless they overlap a
base span; base spans always stay.

The field is trained on the driver from ``TRAINING_ROWS`` generated, labelled token rows (a fixed
seed), so it does not depend on the input and behaves alike at every size. Decoding is exact but
cheap: where the outside score leads by more than transitions can make up, every best path is
outside, so Viterbi only runs over the stretches between such tokens.

Offsets are code points, ends exclusive. Null texts are empty and have no spans. Repeated rows and
null ids each keep their row. An empty table gives no rows. ``find`` reads doc_id and text only;
``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import Cache, in_batches, slices, text_or_empty, word_index, worker

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "crf")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without a word like this has no base span.
_HINT = r"(?i:passw(or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{32}"
TRAINING_ROWS, ROUNDS = 1_500, 150
_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


# --- features -------------------------------------------------------------------------------

_KEYWORD = re.compile(r"(?i)pass(word|wd|phrase)|pwd|secret|token|api.?key|bearer|auth|credential|private|access.?key")
_PREFIX = re.compile(r"^(AKIA|ASIA|gh[pousr]_|sk[-_]|pk_|xox[abprs]-|eyJ|AIza|glpat-)")
_MARKS = "\"'()[]{}<>,;.!?"
_LENGTHS = (4, 8, 12, 16, 20, 28, 40)
#: Shape features: length classes, then the flags below, in this order.
FLAGS = ("digit", "lower", "upper", "digits_only", "hex_only", "mixed", "many_digits", "distinct", "joiner", "assign", "prefix", "keyword", "colon", "symbols", "url", "vowels", "bias")
N_FEATURES = len(_LENGTHS) + 1 + len(FLAGS)
DOC_BUCKETS = 4


def length_class(n: int) -> int:
    return sum(n >= x for x in _LENGTHS)


def features(token: str) -> list[int]:
    """Numbers of the features that hold for a token."""
    core = token.strip(_MARKS)
    value = re.split(r"[=:]", core)[-1].strip(_MARKS) or core
    n = len(value)
    digits, lower, upper = sum(c.isdigit() for c in value), sum(c.islower() for c in value), sum(c.isupper() for c in value)
    holds = {
        "digit": digits > 0, "lower": lower > 0, "upper": upper > 0, "digits_only": n > 0 and digits == n,
        "hex_only": n >= 16 and digits > 0 and all(c in "0123456789abcdefABCDEF" for c in value),
        "mixed": n >= 12 and digits > 1 and (lower > 1 or upper > 1) and digits + lower + upper > 0.8 * n and bool(re.search(r"[A-Za-z]\d.*[A-Za-z]|\d[A-Za-z].*\d", value)),
        "many_digits": n > 0 and 4 * digits > n, "distinct": n >= 12 and len(set(value)) > 9, "joiner": bool(re.search(r"[-_/+.]", value)),
        "assign": "=" in core, "prefix": bool(_PREFIX.match(value)), "keyword": bool(_KEYWORD.search(core)), "colon": token.endswith((":", "=")),
        "symbols": bool(re.search(r"[#$%&*|@~^]", token)), "url": "://" in token or "@" in token or token.startswith("www."),
        "vowels": n > 0 and 0.25 < sum(c in "aeiouAEIOU" for c in value) / n < 0.6, "bias": True,
    }
    return [length_class(n), *(len(_LENGTHS) + 1 + i for i, f in enumerate(FLAGS) if holds[f])]


# --- training -------------------------------------------------------------------------------


def training_rows(n: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Generated (tokens, tags) rows; tags: 0 outside, 1 begin, 2 inside."""
    r = random.Random(seed)
    syllables = "the an on re er in at es ti en ly ed ing st ha or nt is to hea sh ver ung que ción eau man lo pa".split()
    b64, low, up = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def some(letters: str, a: int, b: int) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(a, b)))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        w = w.capitalize() if r.random() < 0.12 else w
        return w + (r.choice(".,.,.,;:!?") if r.random() < 0.15 else "")

    def plain() -> list[str]:
        """What looks odd but is no secret."""
        return [r.choice([
            lambda: some("0123456789", 1, 16), lambda: f"+1({r.randint(200, 999)})", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"https://{word()}.example.com/{word()}/{r.randint(1, 9999)}",
            lambda: f"{word().lower()}@{word().lower()}.org", lambda: word() + r.choice(["$$$", "%%%", "###", "&&&", "***"]), lambda: word().upper(), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"{word()}={r.randint(0, 99)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: "-".join(word().lower().strip(".,;:!?") for _ in range(3)), lambda: "|", lambda: word() * 3, lambda: r.choice(["password", "token", "secret", "key:"]), lambda: some(low, 2, 7),
        ])()]

    def secret() -> tuple[list[str], list[int]]:
        key = r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth", "bearer", "credential", "pwd", "private_key", "access_key"])
        value = r.choice([lambda: some(b64, 16, 48), lambda: some(low, 16, 40), lambda: "AKIA" + some(up, 16, 16), lambda: some("0123456789abcdef", 18, 64), lambda: "ghp_" + some(b64, 36, 36), lambda: "sk-" + some(b64, 32, 48), lambda: "eyJ" + some(b64, 20, 40) + "." + some(b64, 20, 40), lambda: "xoxb-" + some("0123456789", 10, 12) + "-" + some(b64, 16, 24)])()
        form = r.random()
        if form < 0.3:
            return [f"{key}{r.choice('=:')}{r.choice(['', chr(34)])}{value}"], [1]
        if form < 0.5:
            return [key + r.choice([":", "=", ""]), value], [0, 1]
        if form < 0.6:
            return [key, r.choice(["=", ":", "is"]), value], [0, 0, 1]
        if form < 0.7:
            return [key + ":", value, some(b64, 24, 48)], [0, 1, 2]
        return [value + r.choice(["", "", ".", ","])], [1]

    out = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(r.randint(6, 30)):
            x = r.random()
            t, g = secret() if x < 0.04 else (plain(), [0]) if x < 0.16 else ([word()], [0])
            tokens += t
            tags += g
        out.append((tokens, tags))
    return out


def doc_bucket(n_digit_words, n_words):
    """Class of a text by its share of tokens with a digit: none, under 2, under 10 percent, more."""
    import numpy as np

    share = n_digit_words / np.maximum(n_words, 1)
    return (share > 0).astype(int) + (share >= 0.02) + (share >= 0.1)


class Field:
    """A linear-chain conditional random field over tags O, B, I."""

    _made: dict[tuple, "Field"] = {}

    def __init__(self, own, before, after, doc, move, start, end):
        self.own, self.before, self.after, self.doc, self.move, self.start, self.end = own, before, after, doc, move, start, end

    @classmethod
    def trained(cls, n: int = TRAINING_ROWS, seed: int = 7) -> "Field":
        if (n, seed) not in cls._made:
            cls._made[n, seed] = cls.train(training_rows(n, seed))
        return cls._made[n, seed]

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> "Field":
        """Maximum likelihood by adaptive gradient steps, all rows at once."""
        import numpy as np

        n, t = len(rows), max(len(x) for x, _ in rows)
        k = N_FEATURES
        x = np.zeros((n, t, 3 * k + DOC_BUCKETS), "float32")
        y, live = np.zeros((n, t), int), np.zeros((n, t), bool)
        known: dict[str, list[int]] = {}
        for i, (tokens, tags) in enumerate(rows):
            f = [known.setdefault(w, features(w)) for w in tokens]
            bucket = int(doc_bucket(np.array(sum(any(c.isdigit() for c in w) for w in tokens)), np.array(len(tokens))))
            for j, g in enumerate(tags):
                x[i, j, f[j]] = 1
                if j:
                    x[i, j, [k + a for a in f[j - 1]]] = 1
                if j + 1 < len(tags):
                    x[i, j, [2 * k + a for a in f[j + 1]]] = 1
                x[i, j, 3 * k + bucket] = 1
                y[i, j], live[i, j] = g, True
        last = live.sum(1) - 1
        flat, one = x.reshape(n * t, -1), np.eye(3)
        w, move, start, end = np.zeros((x.shape[2], 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(3)
        seen = [np.full_like(p, 1e-8) for p in (w, move, start, end)]
        pairs = live[:, 1:]
        truth_move = np.einsum("nta,ntb->ab", one[y[:, :-1]] * pairs[..., None], one[y[:, 1:]])

        def total(a, axis):
            m = a.max(axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

        for _ in range(rounds):
            e = (flat @ w.astype("float32")).reshape(n, t, 3).astype(float)
            fore, back = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            fore[:, 0] = start + e[:, 0]
            for j in range(1, t):
                fore[:, j] = np.where(live[:, j, None], total(fore[:, j - 1, :, None] + move, 1) + e[:, j], fore[:, j - 1])
            z = total(fore[:, -1] + end, 1)
            back[:, -1] = end
            for j in range(t - 2, -1, -1):
                back[:, j] = np.where(live[:, j + 1, None], total(move + (e[:, j + 1] + back[:, j + 1])[:, None, :], 2), end)
            p = np.exp(fore + back - z[:, None, None]) * live[..., None]
            p_move = np.exp(fore[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
            grads = (
                flat.T @ ((one[y] * live[..., None]) - p).reshape(n * t, 3).astype("float32") / n - decay * w,
                (truth_move - p_move.sum((0, 1))) / n - decay * move,
                (one[y[:, 0]] - p[:, 0]).mean(0) - decay * start,
                (one[y[np.arange(n), last]] - p[np.arange(n), last]).mean(0) - decay * end,
            )
            for q, g, s in zip((w, move, start, end), grads, seen):
                s += g * g
                q += rate * g / np.sqrt(s)
        return cls(w[:k], w[k : 2 * k], w[2 * k : 3 * k], w[3 * k :], move, start, end)

    def vectors(self, token: str) -> bytes:
        """What a token adds to its own scores, to the next token's and to the one's before, as 9 floats."""
        import numpy as np

        f = features(token)
        return np.concatenate([self.own[f].sum(0), self.before[f].sum(0), self.after[f].sum(0)]).astype("float32").tobytes()

    def viterbi(self, e, first: bool, final: bool) -> list[int]:
        """Best tags of one stretch; before it and behind it, unless first or final, stands an outside token."""
        n = len(e)
        m = [[float(v) for v in row] for row in self.move]
        score = [float(e[0][b]) + float(self.start[b] if first else m[0][b]) for b in range(3)]
        back = []
        for i in range(1, n):
            new, came = [], []
            for b in range(3):
                a = max(range(3), key=lambda a: score[a] + m[a][b])
                new.append(score[a] + m[a][b] + float(e[i][b]))
                came.append(a)
            score = new
            back.append(came)
        tag = max(range(3), key=lambda b: score[b] + (float(self.end[b]) if final else m[b][0]))
        out = [tag]
        for came in reversed(back):
            tag = came[tag]
            out.append(tag)
        return out[::-1]


#: Words of letters only, perhaps capitalized, with an end mark.
_PLAIN = r"^[A-Z]?[^\x00-\x60\x7b-\x7f]*[.,]?$"


def _ranges(holds) -> str:
    """The characters from U+0080 on of which something holds, as the inside of a character class."""
    places = [i for i in range(0x80, 0x20000) if holds(chr(i))]  # no digit and no case beyond
    starts = [i for i, before in zip(places, [0, *places]) if i != before + 1]
    ends = [i for i, after in zip(places, [*places[1:], 0]) if after != i + 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


class Scanner:
    """Finds the spans of whole texts, a batch at a time."""

    _made: dict[int, "Scanner"] = {}

    def __init__(self, field: Field):
        import numpy as np

        self.field, self.cache = field, Cache(lambda keys: list(map(field.vectors, keys)))
        self.gap = 2 * max(float(m.max() - m.min()) for m in (np.concatenate([field.move.ravel(), field.start, field.end]),)) + 1e-3
        self.doc = field.doc.astype("float32")
        self.digit, self.lower = f"[0-9{_ranges(str.isdigit)}]", f"[a-z{_ranges(str.islower)}]"
        # letters that a keyword's pattern takes for i and s, and what is not told by length and vowels
        self.special = f"[\u0131\u017f{_ranges(lambda c: c.isdigit() or c.isupper())}]"

    def tags(self, texts):
        """By row with a secret token: {row: [(place of the word, tag)]}, and whether each row can have base spans."""
        import numpy as np
        import pyarrow.compute as pc

        at, index, distinct = word_index(texts)
        lengths = pc.utf8_length(distinct).to_numpy()
        bare = pc.ascii_lower(pc.utf8_rtrim(distinct, ".,"))
        keyword = pc.match_substring_regex(bare, "pass(word|wd|phrase)|pwd|secret|token|api.?key|bearer|auth|credential|private|access.?key").to_numpy(zero_copy_only=False)
        odd = ~pc.match_substring_regex(distinct, _PLAIN).to_numpy(zero_copy_only=False) | keyword | (lengths >= 12) | pc.match_substring_regex(distinct, self.special).to_numpy(zero_copy_only=False)
        digit = pc.match_substring_regex(distinct, self.digit).to_numpy(zero_copy_only=False)
        hint = pc.match_substring_regex(distinct, _HINT).to_numpy(zero_copy_only=False)
        # plain words: those alike in length class, capital, case and vowel share have the same features; words that may have others go to features()
        table = np.zeros((len(distinct), 9), "float32")
        plain = np.flatnonzero(~odd)
        if len(plain):
            keys = self.plain_keys(distinct.take(plain), lengths[plain])
            kinds, inverse = np.unique(keys, return_inverse=True)
            table[plain] = np.stack([self.plain_vector(int(k)) for k in kinds])[inverse]
        rest = np.flatnonzero(odd)
        if len(rest):
            table[rest] = np.frombuffer(b"".join(self.cache.values_of(distinct.take(rest).to_pylist())), "float32").reshape(-1, 9)
        count = np.diff(at)
        has = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag[index])])[at])
        n_digit = has(digit)
        e = table[index, 0:3] + np.repeat(self.doc[doc_bucket(n_digit, count)], count, axis=0)
        inner = np.ones(len(index), bool)
        inner[at[:-1][count > 0]] = False  # first words have nothing before
        e[1:] += table[index[:-1], 3:6] * inner[1:, None]
        e[:-1] += table[index[1:], 6:9] * inner[1:, None]
        free = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.gap)
        found: dict[int, list[tuple[int, int]]] = {}
        if len(free):
            row = np.searchsorted(at, free, side="right") - 1
            cuts = np.flatnonzero((np.diff(free) > 1) | (np.diff(row) > 0)) + 1
            for part in np.split(np.arange(len(free)), cuts):
                s, t, d = int(free[part[0]]), int(free[part[-1]]) + 1, int(row[part[0]])
                tags = self.field.viterbi(e[s:t], s == at[d], t == at[d + 1])
                found.setdefault(d, []).extend((s + i - int(at[d]), g) for i, g in enumerate(tags) if g)
        return {d: x for d, x in found.items() if x}, has(hint) > 0

    def plain_keys(self, words, lengths):
        """Length class, capital and end mark and vowel share of plain words, as one number."""
        import numpy as np
        import pyarrow.compute as pc

        marked = pc.match_substring_regex(words, "[.,]$").to_numpy(zero_copy_only=False)
        upper = pc.match_substring_regex(words, "^[A-Z]").to_numpy(zero_copy_only=False)
        n = np.maximum(lengths - marked, 0)
        vowels = pc.count_substring_regex(words, "[aeiouAEIOU]").to_numpy()
        share = vowels / np.maximum(n, 1)
        lower = pc.match_substring_regex(words, self.lower).to_numpy(zero_copy_only=False)
        klass = sum((n >= x).astype(int) for x in _LENGTHS)
        return klass * 16 + upper * 8 + ((share > 0.25) & (share < 0.6) & (n > 0)) * 4 + lower * 2

    def plain_vector(self, key: int):
        import numpy as np

        base = len(_LENGTHS) + 1
        f = [key // 16, base + FLAGS.index("bias")]
        for bit, flag in ((8, "upper"), (4, "vowels"), (2, "lower")):
            if key & bit:
                f.append(base + FLAGS.index(flag))
        own, before, after = self.field.own, self.field.before, self.field.after
        return np.concatenate([own[f].sum(0), before[f].sum(0), after[f].sum(0)]).astype("float32")

    def spans(self, texts) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of each row, sorted."""
        found, hinted = self.tags(texts)
        out: list[list] = [[] for _ in range(len(texts))]
        for d in sorted({*found, *hinted.nonzero()[0].tolist()}):
            text = texts[d].as_py() or ""
            base = base_spans(text) if hinted[d] else []
            spans = list(base)
            if d in found:
                places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                runs: list[list[int]] = []
                for k, g in found[d]:
                    if g == 2 and runs and runs[-1][1] == k:
                        runs[-1][1] = k + 1
                    else:  # an inside without a begin opens a span
                        runs.append([k, k + 1])
                for k, n in runs:
                    s, e = places[k][0], places[n - 1][1]
                    first = text[s : places[k][1]]
                    if m := re.match(r"""[^=:]*[=:]["']*(?=[^\s=:"']{6})""", first):
                        s += m.end()
                    while s < e and text[s] in _MARKS:
                        s += 1
                    while e > s and text[e - 1] in _MARKS:
                        e -= 1
                    if e > s and not any(s < y and x < e for x, _, y in base):
                        spans.append((s, 3, e))
            out[d] = sorted(spans)
        return out


_SCANNERS: dict[int, Scanner] = {}


def _scanner(parts: tuple) -> Scanner:
    """One scanner for each Python worker."""
    key = hash(tuple(p.tobytes() for p in parts))
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(Field(*parts))
    return _SCANNERS[key]


def _parts(field: Field | None) -> tuple:
    f = field or Field.trained()
    return (f.own, f.before, f.after, f.doc, f.move, f.start, f.end)


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans) of every document; spans by start, then kind as listed in ``KINDS``."""
    parts = _parts(field)

    @worker("secrets")
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches, most_bytes=6 << 20):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in _scanner(parts).spans(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each run of overlapping spans of ``text`` put as ``[SECRET]``; ``n_chars``, if there, follows."""
    parts, names = _parts(field), docs.columns
    schema = docs.schema

    @worker("secrets")
    def run(batches):
        import pyarrow as pa

        for b in slices(batches, most_bytes=6 << 20):
            texts = b.column("text")
            new, sizes = {}, {}
            for i, spans in enumerate(_scanner(parts).spans(texts)):
                if spans:
                    text, out, at = texts[i].as_py(), [], 0
                    for s, _, e in spans:
                        if s >= at:
                            out += [text[at:s], "[SECRET]"]
                        at = max(at, e)
                    new[i] = "".join([*out, text[at:]])
                    sizes[i] = len(new[i])
            if new:
                columns = {n: b.column(n) for n in names}
                columns["text"] = pa.array([new.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([sizes.get(i, x) for i, x in enumerate(b.column("n_chars").to_pylist())], b.column("n_chars").type)
                b = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield b

    return in_batches(docs, run, schema)


def digests(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digests of the spans of every document."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    put = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base: Column = put(F.filter("spans", lambda s: s["kind"] != "crf"))
    return find(docs, field).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), put(F.col("spans")).alias("spans"), n("crf"))
