"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base patterns run only on stretches of text that can hold a match, found by
NumPy on the byte buffer. The field then reads every stretch of tokens with a
digit or @: whole-span features score each candidate segment, and a dynamic
program over segments of at most MAX_TOKENS tokens chooses boundaries and types
together. It is trained in NumPy on generated sentences.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import append_columns, flat, named, word_spans

# Fixed values of the contract: the kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[^@]@[A-Za-z0-9-]+\.[A-Za-z0-9-]")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds that only the field finds.
ADDED = ("local_phone", "secret", "iban", "national_id")
TYPES = (*KINDS, *ADDED)
MAX_TOKENS = 7
#: A segment is added if the field's odds for it against any other reading of its stretch exceed this log ratio.
MARGIN = 2.0


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_MAIL = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_NUMBER = _table(b"0123456789.+ ()-")
_DIGIT = _table(b"0123456789")
_MARK = _table(b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number in IBAN form passes its check."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _in_number(run: bytes, at: int) -> list[tuple[str, int, int]]:
    """ip, card and phone matches inside one stretch of number signs."""
    out = []
    if run.count(b".") >= 3:
        for m in IP.finditer(run):
            if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m.group().split(b".")):
                out.append(("ip", at + m.start(), at + m.end()))
    if len(run) >= 10:
        for m in CARD.finditer(run):
            digits = re.sub(rb"[^0-9]", b"", m.group()).decode() if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at + m.start(), at + m.end()))
        if b"+" in run:
            for m in PHONE.finditer(run):
                if 10 <= sum(48 <= c <= 57 for c in m.group()) <= 15:
                    out.append(("phone", at + m.start(), at + m.end()))
    return out


def base_spans(data: np.ndarray, off: np.ndarray) -> list[tuple[str, int, int]]:
    """All base matches in a flat buffer as (kind, start, end) in bytes of the buffer."""
    out: list[tuple[str, int, int]] = []
    for text in np.unique(np.searchsorted(off, np.flatnonzero(data == 64), "right") - 1):
        lo, hi = off[text], off[text + 1]
        own = data[lo:hi]
        s, e, _ = word_spans(own, np.array([0, hi - lo]), _MAIL)
        c = np.append(0, np.cumsum(own == 64))
        for a, b in zip(s[c[e] > c[s]].tolist(), e[c[e] > c[s]].tolist(), strict=True):
            run = own[a:b].tobytes()
            if not _DOTTED.search(run):
                continue
            out += [("email", int(lo) + a + m.start(), int(lo) + a + m.end()) for m in EMAIL.finditer(run)]
    number = _NUMBER[data]
    if number.any():
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_DIGIT[data], out=c[1:])
        s, e, _ = word_spans(data, off, _NUMBER)
        for k in np.flatnonzero(c[e] - c[s] >= 4):
            out += _in_number(data[s[k] : e[k]].tobytes(), int(s[k]))
    return out


# ---- the field -------------------------------------------------------------


@dataclass
class Field:
    """weights[feature, type]; the last column is the type of a token outside any segment."""

    weights: np.ndarray
    features: dict[str, int]

    def score(self, names: list[str]) -> np.ndarray:
        ids = [self.features[n] for n in names if n in self.features]
        return self.weights[ids].sum(0)


def span_features(span: str, n_tokens: int, before: str) -> list[str]:
    """Features of a whole candidate segment and of the word before it."""
    digits = "".join(c for c in span if c.isdigit())
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", span))))
    f = ["bias", f"tokens={n_tokens}", f"digits={min(len(digits), 20)}", f"shape={shape[:12]}", f"first={shape[:1]}", f"letters={min(3, letters)}", f"before={before.lower()[:12]}"]
    if "@" in span:
        f.append("at=" + ("mail" if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", span, re.ASCII) else "other"))
    if 14 <= len(digits) <= 19 and not letters:
        f.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span, re.ASCII):
        f.append(f"octets={all(len(p) < 4 and int(p) <= 255 for p in span.split('.'))}")
    if re.fullmatch(r"\+[0-9][ ().0-9-]+[0-9]", span, re.ASCII):
        f.append(f"plus={10 <= len(digits) <= 15}")
    if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span, re.ASCII):
        f.append("national")
    if n_tokens == 1 and len(span) >= 16 and letters and digits and span.isascii() and span.isalnum():
        f += ["key", "key=" + ("upper" if span.isupper() else "hex" if re.fullmatch(r"[0-9a-f]+", span) else "mixed" if not span.islower() else "lower")]
    account = span.replace(" ", "")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", account, re.ASCII):
        f.append(f"mod97={mod97(account)}")
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span, re.ASCII):
        f.append("threetwofour")
    if "," in span or ";" in span or " - " in span:
        f.append("breaks")
    return f


def lattice(field: Field, tokens: list[str], spans: list[tuple[int, int]], text: str, before: str) -> list[list[np.ndarray]]:
    """score[j][l-1]: scores of all types for the segment of l tokens that ends with token j."""
    out = []
    for j in range(len(tokens)):
        row = []
        for n in range(1, min(MAX_TOKENS, j + 1) + 1):
            i = j - n + 1
            row.append(field.score(span_features(text[spans[i][0] : spans[j][1]], n, tokens[i - 1] if i else before)))
        out.append(row)
    return out


def _sum(x: list[float]) -> float:
    m = max(x)
    return m + float(np.log(np.exp(np.array(x) - m).sum()))


def partition(score: list[list[np.ndarray]]) -> tuple[list[float], list[float]]:
    """Log sums over all segmentations of the tokens before j, and of those from j on."""
    n, k = len(score), len(TYPES)
    fwd, bwd = [0.0] + [-1e30] * n, [-1e30] * n + [0.0]

    def total(j: int, size: int) -> float:
        s = score[j][size - 1]
        return _sum(list(s[: k + 1] if size == 1 else s[:k]))

    cached = [[total(j, size) for size in range(1, len(score[j]) + 1)] for j in range(n)]
    for j in range(n):
        fwd[j + 1] = _sum([fwd[j + 1 - size] + cached[j][size - 1] for size in range(1, len(score[j]) + 1)])
    for i in range(n - 1, -1, -1):
        bwd[i] = _sum([cached[j][j - i] + bwd[j + 1] for j in range(i, min(n, i + MAX_TOKENS))])
    return fwd, bwd


def decode(score: list[list[np.ndarray]]) -> list[tuple[int, int, str]]:
    """The best segmentation's entities as (first token, tokens, type)."""
    n, k = len(score), len(TYPES)
    best, back = [0.0] + [-1e30] * n, [None] * (n + 1)
    for j in range(n):
        for size in range(1, len(score[j]) + 1):
            s = score[j][size - 1]
            y = int(np.argmax(s[: k + 1] if size == 1 else s[:k]))
            v = best[j + 1 - size] + float(s[y])
            if v > best[j + 1]:
                best[j + 1], back[j + 1] = v, (size, y)
    out, j = [], n
    while j:
        size, y = back[j]
        if y < k:
            out.append((j - size, size, TYPES[y]))
        j -= size
    return out[::-1]


def _examples(rng: np.random.Generator, n: int) -> list[tuple[list[str], list[tuple[int, int, str]], str]]:
    """Generated stretches: (tokens, entities, word before)."""
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    a = lambda k, alphabet="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(alphabet), k))
    octet = lambda: str(rng.integers(0, 256))

    def card() -> str:
        body = str(rng.integers(3, 7)) + d(int(rng.integers(13, 16)) - 1)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def account() -> str:
        land, tail = a(2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), d(int(rng.integers(11, 24)))
        check = next(f"{c:02d}" for c in range(2, 99) if mod97(f"{land}{c:02d}{tail}"))
        return f"{land}{check}{tail}"

    def entity(kind: str) -> str:
        if kind == "email":
            return f"{a(int(rng.integers(3, 9)))}{rng.choice(['', '.', '.' + d(2)])}{a(2)}@{a(6)}.{rng.choice(['example.com', 'org', 'net'])}"
        if kind == "ip":
            return ".".join(octet() for _ in range(4))
        if kind == "card":
            c = card()
            return c if rng.random() < 0.5 else " ".join(c[i : i + 4] for i in range(0, len(c), 4))
        if kind == "phone":
            return rng.choice([f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.integers(1, 99)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}"])
        if kind == "local_phone":
            return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"])
        if kind == "iban":
            c = account()
            return c if rng.random() < 0.6 else " ".join(c[i : i + 4] for i in range(0, len(c), 4))
        if kind == "national_id":
            return f"{d(3)}-{d(2)}-{d(4)}"
        return rng.choice(["AKIA" + a(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), a(40, "0123456789abcdef"), a(32, "0123456789abcdef"), a(40, "0123456789ABCDEF"), a(int(rng.integers(20, 48)), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")])

    def noise() -> str:
        return rng.choice([str(rng.integers(1900, 2100)), d(1), d(2), d(3), d(5), d(8), f"{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{a(3)}{d(2)}", f"{d(1)}.{d(1)}.", f"{d(2)}%", f"{d(1)},{d(3)}", f"@{a(6)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)}/{d(2)}", f"({d(1)})", d(16), f"{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}.9{d(3)}", f"{a(1)}{d(1)}{a(2)}{d(2)}{a(1)}", f"{a(8)}{d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(2)}/{d(2)}/{d(4)}", f"{a(2, 'ABCDXYZ')}-{d(4)}", f"{d(2)}-{d(2)}-{d(4)}", f"{a(2, 'ABCDXYZ')}{d(13)}", f"{a(6)}_{a(8)}_{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}"])

    out = []
    for _ in range(n):
        tokens: list[str] = []
        gold = []
        before = str(rng.choice(["the", "to", "=", "token", "call", "and", ""]))
        for _ in range(rng.integers(1, 5)):
            if rng.random() < 0.5:
                kind = str(rng.choice(TYPES))
                parts = str(entity(kind)).split(" ")
                gold.append((len(tokens), len(parts), kind))
                tokens += parts
            else:
                tokens.append(str(noise()))
        out.append((tokens, gold, before))
    return out


@lru_cache(maxsize=1)
def train(sentences: int = 800, epochs: int = 6, seed: int = 3) -> Field:
    """Maximise the conditional likelihood of generated segmentations by stochastic gradient ascent."""
    rng = np.random.default_rng(seed)
    data, names = [], {}
    k = len(TYPES)
    for tokens, gold, before in _examples(rng, sentences):
        text, spans, at = " ".join(tokens), [], 0
        for t in tokens:
            spans.append((at, at + len(t)))
            at += len(t) + 1
        ids = []
        for j in range(len(tokens)):
            row = []
            for n in range(1, min(MAX_TOKENS, j + 1) + 1):
                i = j - n + 1
                f = span_features(text[spans[i][0] : spans[j][1]], n, tokens[i - 1] if i else before)
                row.append([names.setdefault(x, len(names)) for x in f])
            ids.append(row)
        inside = {i + m: None for i, n, _ in gold for m in range(n)}
        segments = [(i + n - 1, n, TYPES.index(y)) for i, n, y in gold if n <= MAX_TOKENS] + [(j, 1, k) for j in range(len(tokens)) if j not in inside]
        if all(n <= MAX_TOKENS for _, n, _ in gold):
            data.append((ids, segments))
    w = np.zeros((len(names), k + 1))
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch)
        for q in rng.permutation(len(data)):
            ids, segments = data[q]
            score = [[w[f].sum(0) for f in row] for row in ids]
            fwd, bwd = partition(score)
            z = fwd[-1]
            for j, row in enumerate(ids):
                for n, f in enumerate(row, 1):
                    p = np.exp(np.minimum(0, score[j][n - 1] + fwd[j + 1 - n] + bwd[j + 1] - z))
                    if n > 1:
                        p[k] = 0
                    if p.max() > 1e-4:
                        w[f] -= rate * p
            for j, n, y in segments:
                w[ids[j][n - 1], y] += rate
    return Field(w, names)


_STRIP_LEFT, _STRIP_RIGHT = "\"'`[{<|=#$%&*!", "\"'`.,;:!?]}>|=#$%&*"


def field_spans(field: Field, text: str) -> list[tuple[str, int, int]]:
    """Segments the field is sure of, as (kind, start, end) in code points of text."""
    out = []
    stretch: list[tuple[int, int]] = []
    before, previous = "", ""

    def close() -> None:
        nonlocal stretch
        if stretch:
            tokens = [text[s:e] for s, e in stretch]
            score = lattice(field, tokens, stretch, text, before)
            found = decode(score)
            if found:
                fwd, bwd = partition(score)
                for i, n, kind in found:
                    j = i + n - 1
                    log_p = score[j][n - 1][TYPES.index(kind)] + fwd[i] + bwd[j + 1] - fwd[-1]
                    if log_p > -np.log1p(np.exp(-MARGIN)):
                        out.append((kind, stretch[i][0], stretch[j][1]))
        stretch = []

    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        s, e = m.span()
        word = m.group()
        if any(c in "0123456789@" for c in word):
            while s < e and text[s] in _STRIP_LEFT:
                s += 1
            while e > s and text[e - 1] in _STRIP_RIGHT:
                e -= 1
            if not stretch:
                before = previous
            stretch.append((s, e))
        else:
            close()
        previous = word
    close()
    return out


def _marked(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a digit or an @ sign, so that the field reads them."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_MARK[data], out=c[1:])
    return np.flatnonzero(c[off[1:]] > c[off[:-1]])


def _neighbourhoods(data: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Parts of a text around its digits and @ signs, cut between words, so that each stretch is whole in one part."""
    own = data[lo:hi]
    s, e, _ = word_spans(own, np.array([0, hi - lo]))
    c = np.zeros(len(own) + 1, np.int64)
    np.cumsum(_MARK[own], out=c[1:])
    hit = np.flatnonzero(c[e] > c[s])
    if not len(hit):
        return []
    first = np.flatnonzero(np.append(True, np.diff(hit) > 1))
    last = np.append(first[1:], len(hit)) - 1
    return [(lo + int(s[max(0, hit[a] - 1)]), lo + int(e[hit[b]])) for a, b in zip(first, last, strict=True)]


def find_spans(texts: pa.Array, field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base, all) spans of each text in code points, ordered by start, then kind."""
    data, off = flat(texts)
    base: dict[int, list] = {}
    for kind, s, e in base_spans(data, off):
        base.setdefault(int(np.searchsorted(off, s, "right")) - 1, []).append((kind, s, e))
    out: list = [([], [])] * (len(off) - 1)
    order = {k: i for i, k in enumerate(TYPES)}
    for i in _marked(data, off):
        lo, hi = int(off[i]), int(off[i + 1])
        own = base.get(int(i), [])
        parts = _neighbourhoods(data, lo, hi)
        if not own and not parts:
            continue
        wide = bool((data[lo:hi] >= 128).any())
        if wide:
            point = np.append(0, np.cumsum((data[lo:hi] & 0xC0) != 0x80))
        at = (lambda b: int(point[b - lo])) if wide else (lambda b: b - lo)
        plain = sorted(((k, at(s), at(e)) for k, s, e in own), key=lambda x: (x[1], order[x[0]]))
        taken = [(s, e) for _, s, e in plain]
        more = []
        for a, b in parts:
            start = at(a)
            for kind, s, e in field_spans(field, data[a:b].tobytes().decode("utf-8", "replace")):
                s, e = s + start, e + start
                if kind in ADDED and not any(s < y and x < e for x, y in taken):
                    more.append((kind, s, e))
        out[i] = (plain, sorted(plain + more, key=lambda x: (x[1], order[x[0]])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def add_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (base matches), base_sha256 and spans to docs.

    Base spans always stay; the field adds spans of the kinds ADDED that overlap
    none of them. Null and empty texts have no spans and the digest of nothing. Spans that start together are
    in the order of the kinds; equally good segmentations go to the shorter last segment. Repeated rows and ids each
    keep their row; the new columns replace columns of the same name. Texts are read whole: patterns run on stretches
    of their signs and the field on stretches of words with a digit or @, however long.
    """
    field = train()

    def make(texts: pa.Array):
        found = find_spans(texts, field)
        counts = [[sum(x[0] == k for x in b) for b, _ in found] for k in KINDS]
        return *counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], [joined(a) for _, a in found]

    new = [(f"n_{k}", T.LongType(), pa.int64()) for k in KINDS] + [("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string())]
    return append_columns(docs, text_col, make, new, keep)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans go as one."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of documents; a null text counts as empty, an empty table gives no row."""
    return add_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data give way to their kind in brackets; n_chars follows the text.

    Every row stays, null and empty texts as they are, repeated rows and null ids too; extra columns may have any name.
    An empty table stays empty.
    """
    field = train()

    def make(texts: pa.Array):
        new = [redact(t, s) for t, (_, s) in zip(texts.to_pylist(), find_spans(texts, field), strict=True)]
        return new, [None if t is None else len(t) for t in new]

    packed = docs.select(F.struct(*(named(c) for c in docs.columns if c.lower() not in ("text", "n_chars"))).alias("row"), F.col("text").alias("old"))
    out = append_columns(packed, "old", make, [("text", T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())], ["row"])
    kind = next((f.dataType for f in docs.schema if f.name.lower() == "n_chars"), T.LongType())
    return out.select("row.*", "text", F.col("n_chars").cast(kind).alias("n_chars")).select(*(named(c).alias(c) for c in docs.columns))
