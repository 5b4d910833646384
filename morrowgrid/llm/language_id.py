"""Language ID: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Calibration documents (every fifth of the sample, not trained on) are cut to prefixes, so that each length class of
texts has a calibration of its own. It also sees noise, the same prefixes with their letters shuffled or replaced by
random ones, for which only the even guess is right: a logistic model of a text's margin between the two best languages
and of its share of 4-byte subwords that no training document has gives the chance that the text is language of a
learned kind at all. The score is the softmax's chance of the best language, pulled towards the even guess by as much
as that chance is below one; the temperature is the one that makes the scores of prefixes and noise fit best. A text is
rejected if its score is below its class's threshold, which lies between the scores of the prefixes and those of the
noise, nearer to the latter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import append_columns, flat, named, spread, word_spans

#: Subword sizes in bytes, hash buckets of each size, and the embedding's dimensions.
GRAMS, BUCKETS, DIM = (3, 4), 1 << 14, 16
#: Documented bound on the training sample: expected documents of each language.
SAMPLE_PER_LANGUAGE = 400
#: Each threshold is the quantile that leaves this share of the calibration documents out.
REJECT_SHARE = 0.001
#: Bits of the table of known 4-byte subwords; the bytes at which a length class begins; calibration prefixes of each class, in bytes.
KNOWN_BITS, CLASSES, PREFIX = 20, (32, 128, 512), (16, 48, 192, 512)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_NO_WORD = np.array([chr(b) in "0123456789@" for b in range(256)])


def _buckets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each subword size the buckets of all positions; and the byte offsets of the texts after lower-casing."""
    data, off = flat(pc.utf8_lower(texts))
    d = _FOLD[data].astype(np.uint32)
    pad = np.concatenate([d, np.full(8, 0x20, np.uint32)])
    out, n = [], len(d)
    for k, g in enumerate(GRAMS):
        v = pad[:n].copy()
        for j in range(1, g):
            v = v | (pad[j : n + j] << np.uint32(8 * j))
        h = (v * np.uint32(0x9E3779B1)) >> np.uint32(18)
        out.append(h.astype(np.int64) + k * BUCKETS)
    return out, off, data


def _subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's 4-byte subwords in order; offsets by text.

    Words with a digit or @ (numbers, addresses, keys) count as blanks, and subwords that begin with two blanks are left out.
    """
    data, off = flat(pc.utf8_lower(texts))
    folded, n = _FOLD[data], len(data)
    if n:
        s, e, _ = word_spans(data, off)
        marks = np.append(0, np.cumsum(_NO_WORD[data]))
        odd = marks[e] > marks[s]
        folded[spread(s[odd], (e - s)[odd])] = 0x20
    d = folded.astype(np.uint64)
    pad = np.concatenate([d, np.full(8, 0x20, np.uint64)])
    v = pad[:n] | pad[1 : n + 1] << np.uint64(8) | pad[2 : n + 2] << np.uint64(16) | pad[3 : n + 3] << np.uint64(24)
    ok = (pad[:n] != 0x20) | (pad[1 : n + 1] != 0x20)
    for j in range(1, 4):
        at = off[1:] - j
        ok[at[at >= off[:-1]]] = False
    count = np.append(0, np.cumsum(ok))
    h = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN_BITS)
    return h[ok].astype(np.int64), count[off]


def _sums(values: np.ndarray, off: np.ndarray, g: int) -> np.ndarray:
    """Sum of values[off[i] : off[i+1]-g+1] for each text."""
    out = np.zeros((len(off) - 1, values.shape[1]))
    lo, hi = off[:-1], off[1:] - g + 1
    ok = np.flatnonzero(hi > lo)
    if len(ok):
        at = np.empty(2 * len(ok), np.int64)
        at[0::2], at[1::2] = lo[ok], hi[ok]
        out[ok] = np.add.reduceat(np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)]), at, axis=0, dtype=np.float64)[0::2]
    return out


@dataclass
class LanguageModel:
    """table: each bucket's embedding times the softmax weights (averaging and the linear layer commute).

    The arrays have an entry for each length class.
    """

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: np.ndarray = field(default_factory=lambda: np.ones(len(PREFIX)))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(PREFIX)))
    #: Which subwords were seen, and the logistic weights (constant, margin, share of new subwords) of being language.
    known: np.ndarray | None = None
    sense: np.ndarray = field(default_factory=lambda: np.tile([40.0, 0.0, 0.0], (len(PREFIX), 1)))

    def evidence(self, texts: pa.Array, logits: np.ndarray) -> np.ndarray:
        """Of each text: one, the margin between its two best languages, and its share of new subwords (of none, if it has none)."""
        top = np.sort(logits, 1)
        margin = top[:, -1] - top[:, -2] if logits.shape[1] > 1 else top[:, -1]
        share = np.zeros(len(texts))
        if self.known is not None:
            h, off = _subwords(texts)
            new = np.append(0, np.cumsum(~self.known[h]))
            share = (new[off[1:]] - new[off[:-1]]) / np.maximum(np.diff(off), 1)
        return np.column_stack([np.ones(len(texts)), margin, share])

    def probabilities(self, texts: pa.Array, logits: np.ndarray, kind: np.ndarray) -> np.ndarray:
        sure = sigmoid((self.evidence(texts, logits) * self.sense[kind]).sum(1))
        return sure[:, None] * softmax(logits / self.temperature[kind][:, None]) + (1 - sure[:, None]) / max(1, len(self.langs))

    def logits(self, texts: pa.Array) -> np.ndarray:
        grams, off, _ = _buckets(texts)
        total, n = np.zeros((len(off) - 1, len(self.langs))), np.zeros(len(off) - 1)
        for g, h in zip(GRAMS, grams, strict=True):
            total += _sums(self.table[h], off, g)
            n += np.maximum(0, np.diff(off) - g + 1)
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and rejection of each text; und, 0 and True if it is null or has no letter."""
        lettered = has_letter(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        kind = np.searchsorted(CLASSES, np.diff(flat(texts)[1]), "right")
        p = self.probabilities(texts, self.logits(texts), kind)
        best = p.argmax(1)
        score = np.where(lettered, p.max(1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score, ~lettered | (score < self.threshold[kind])


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    data, off = flat(texts)
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=c[1:])
    some = c[off[1:]] > c[off[:-1]]
    c[1:] = np.cumsum(_LETTER[data] & (data < 128))
    ascii_letter = c[off[1:]] > c[off[:-1]]
    for i in np.flatnonzero(some & ~ascii_letter):
        some[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return some


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic model by Newton's steps on rows x with targets y and weights w; all but the constant are shrunk."""
    beta, scale = np.zeros(x.shape[1]), np.maximum(x.std(0), 1e-9)
    scale[0] = 1
    z, keep = x / scale, np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = sigmoid(z @ beta)
        step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + keep, z.T @ (w * (y - p)) - keep @ beta)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on (buckets, counts, language).

    A bucket's gradient is its share of the text times that of the mean embedding; shares are scaled by 200, at most to 1
    (a per-coordinate rate: buckets of common subwords move as far as the mean does).
    """
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (len(GRAMS) * BUCKETS, DIM))
    Wt = rng.normal(0, 0.1, (DIM, len(langs)))
    b = np.zeros(len(langs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            ids, cnt, y = rows[i]
            w = cnt / max(cnt.sum(), 1)
            v = w @ E[ids]
            p = softmax((v @ Wt + b)[None])[0]
            p[y] -= 1
            dv = Wt @ p
            Wt -= step * np.outer(v, p)
            b -= 0.1 * step * p
            E[ids] -= step * np.minimum(1, 200 * w)[:, None] * dv
    return LanguageModel(langs, (E @ Wt).astype(np.float32), b)


def _prefixes(texts: list[str], size: int) -> list[str]:
    """The first `size` bytes of the texts that are as long, cut between signs."""
    return [b[:size].decode("utf-8", "ignore") for t in texts if len(b := t.encode()) >= size]


def _noise(rng: np.random.Generator, text: str) -> list[str]:
    """The text with its letters shuffled, and with random letters in their places."""
    letters, flat_text = [i for i, c in enumerate(text) if c.isalpha()], list(text)
    mixed, random = flat_text.copy(), flat_text.copy()
    for i, j in zip(letters, rng.permutation(letters), strict=True):
        mixed[i] = flat_text[j]
    for i, c in zip(letters, rng.integers(97, 123, len(letters)), strict=True):
        random[i] = chr(c)
    return ["".join(mixed), "".join(random)]


def calibrate(model: LanguageModel, seen: list[np.ndarray], held: list[tuple[str, int]], seed: int = 5) -> None:
    """Known subwords from `seen`; what each length class asks for, from the beginnings of calibration texts (text, language) and noise."""
    rng = np.random.default_rng(seed)
    model.known = np.zeros(1 << KNOWN_BITS, bool)
    for h in seen:
        model.known[h] = True
    grid, even = np.geomspace(1e-3, 1e3, 241), 1 / max(1, len(model.langs))
    for k, size in enumerate(PREFIX):
        some = [(p, y) for t, y in held for p in _prefixes([t], size)] or held
        noise = [s for p, _ in some for s in _noise(rng, p)]
        texts, y, n = pa.array([p for p, _ in some] + noise, pa.string()), np.array([y for _, y in some]), len(some)
        z = model.logits(texts)
        language = np.append(np.ones(n), np.zeros(len(noise)))
        model.sense[k] = logistic(model.evidence(texts, z), language, np.where(language > 0, 1.0, n / max(1, len(noise))))
        # as many right answers as there are texts make a chance of (n + 1) / (n + 2) at most
        target = np.full((len(z), len(model.langs)), even)
        target[:n] = even / (n + 2)
        target[np.arange(n), y] += (n + 1) / (n + 2)
        kind, loss = np.full(len(z), k), {}
        for t in grid:
            model.temperature[k] = t
            part = -(target * np.log(model.probabilities(texts, z, kind) + 1e-12)).sum(1)
            loss[t] = part[:n].mean() + part[n:].mean()
        model.temperature[k] = min(loss, key=loss.get)
        p = model.probabilities(texts, z, kind)
        right, wrong = p[:n].max(1)[p[:n].argmax(1) == y], p[n:].max(1)
        if len(right):
            low, high = np.quantile(right, REJECT_SHARE, method="lower"), np.quantile(wrong, 0.99, method="lower")
            model.threshold[k] = high + (low - high) / 8 if low > high else low


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from a hash sample (expected size per_language each) of labelled documents that aren't held out.

    The executors send bucket counts and subword hashes, and the first bytes of each text for calibration, not whole texts. A
    language without a lettered text isn't learned; without any label every prediction is `und`. Repeated rows count
    each; the order of the sample follows id and content, so the model doesn't depend on partitions.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((len(GRAMS) * BUCKETS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    u = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    drawn = usable.select(F.col(id_col).alias("mg_id"), F.col(lang_col).alias("mg_lang"), F.col(text_col).alias("mg_text")).where(u < share[F.col("mg_lang")])

    def features(texts: pa.Array):
        grams, off, _ = _buckets(texts)
        sub, sub_off = _subwords(texts)
        ids, cnt, seen = [], [], []
        for i, ok in enumerate(has_letter(texts)):
            h = np.concatenate([g[off[i] : max(off[i], off[i + 1] - k + 1)] for g, k in zip(grams, GRAMS, strict=True)]) if ok else np.zeros(0, np.int64)
            a, n = np.unique(h, return_counts=True)
            ids.append(a.astype(np.uint16).tobytes())
            cnt.append(n.astype(np.uint32).tobytes())
            seen.append(np.unique(sub[sub_off[i] : sub_off[i + 1]]).astype(np.uint32).tobytes())
        return ids, cnt, seen, [(t or "").encode()[: 2 * max(PREFIX)].decode("utf-8", "ignore") for t in texts.to_pylist()]

    new = [(c, T.BinaryType(), pa.binary()) for c in ("mg_ids", "mg_cnt", "mg_seen")] + [("mg_lead", T.StringType(), pa.string())]
    got = [r for r in append_columns(drawn, "mg_text", features, new, keep=["mg_id", "mg_lang"]).collect() if len(r.mg_ids)]
    langs = sorted({r.mg_lang for r in got})
    at = {k: i for i, k in enumerate(langs)}
    rows = sorted(got, key=lambda r: (r.mg_id, bytes(r.mg_ids), r.mg_lang))
    learn, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    learn = learn or held
    model = train([(np.frombuffer(r.mg_ids, np.uint16).astype(np.int64), np.frombuffer(r.mg_cnt, np.uint32).astype(float), at[r.mg_lang]) for r in learn], langs)
    if held:
        calibrate(model, [np.frombuffer(r.mg_seen, np.uint32) for r in learn], [(r.mg_lead, at[r.mg_lang]) for r in held])
    return model


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score and rejected to docs. Null, empty and letterless texts: und, 0, rejected.

    Only the text is read. Equal scores go to the language first by name. Repeated rows each keep their row; texts are read
    whole, in slices that end between texts; the new columns replace columns of the same name. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("rejected", T.BooleanType(), pa.bool_())]
    return append_columns(docs, text_col, lambda texts: shared.value.predict(texts), new, keep, 1 << 20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every row of documents; null and letterless texts are `und` with score 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go, null and letterless texts too; the columns of documents stay, whatever extra ones are called."""
    packed = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("text"))
    return identify(packed, fit(docs), keep=["row"]).where(~F.col("rejected")).select("row.*")
