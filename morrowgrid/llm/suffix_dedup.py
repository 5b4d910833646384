"""Suffix-array deduplication on sparse suffixes.

Of every SUFFIX words in a row in a passage the one with the least fingerprint
is its minimiser; only suffixes that begin at a minimiser are retained (about
one position in 13), and of these those whose first SUFFIX words occur again.
They are sorted by their words, and neighbours compared for their common prefix;
the same is done with the words before them. From both, matches are extended
left and right to all passages of `width` words (see `repeats.suffix_classes`).
Any repeat of `width` words holds a retained suffix, so none is missed.

Suffixes with a beginning that occurs more than `repeats.HOT` times aren't sorted
in one task: their passages of `width` words are compared by 96-bit fingerprint,
dealt out by that fingerprint and merged on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import flat, owner, rolling, word_spans
from .repeats import Shown, Told, covered, repeated_windows
from .substring_dedup import by_position, sliding_max

#: Words of the shortest repeat, and of a retained suffix's key.
PASSAGE, SUFFIX = 50, 25


def minimisers(h: np.ndarray, w_off: np.ndarray, width: int, suffix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, first window, windows) of the retained suffixes: each window's minimiser."""
    size = len(h) - width + 1
    if size <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    text = owner(w_off, len(h))
    least, where = sliding_max(~rolling(h, suffix), width - suffix + 1)
    return by_position(least, where, text[:size] == text[width - 1 :])


class SparseSuffixes:
    """Names are the first words of retained suffixes; one round finds those that occur again."""

    rounds = 1

    def __init__(self, width: int):
        self.suffix = min(SUFFIX, width)

    def ask(self, h: np.ndarray, w_off: np.ndarray, width: int, told: Told, turn: int) -> np.ndarray:
        key, at, _, _ = minimisers(h, w_off, width, self.suffix)
        return key

    def show(self, h: np.ndarray, w_off: np.ndarray, width: int, told: Told) -> Shown:
        key, at, first, n = minimisers(h, w_off, width, self.suffix)
        again, hot = told.find(key)
        return Shown(*(x[again] for x in (key, at, first, n, hot)))


SCHEMA = "doc_id long, n_words long, n_repeat_words long, n_duplicate_words long, spans array<struct<start:long,end:long>>, origins array<long>"


def repeated_passages(docs: DataFrame, width: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with passages of `width` words or more that occur again, in another document or later in the same one.

    n_repeat_words: words in such passages; n_duplicate_words: those whose passage
    also starts earlier, so that a deduplication may drop them; spans: the
    passages as word positions [start, end); origins: ids of the documents where
    they occur first, its own included. A document without one has no row; null,
    empty and shorter texts have none. Rows that share an id are one document with several texts, each with a row
    of its own; an exact copy of a row is no other occurrence. A null id comes after all others. Other columns aren't read;
    texts are taken whole, and a word may be of any length.
    """

    def answer(left: pa.Table, found) -> pa.Table:
        ids = left.column("id").to_pylist()
        text = left.column("text").combine_chunks()
        data, off = flat(text)
        _, _, w_off = word_spans(data, off)
        rows = []
        for i, (lo, n, origin, later) in enumerate(found):
            if not len(lo):
                continue
            words = int(w_off[i + 1] - w_off[i])
            every = covered(lo, n, width, words)
            late = later > 0
            duplicate = covered(lo[late], n[late], width, words)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], every, [False]]).astype(np.int8)))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]
            rows.append((ids[i], words, int(every.sum()), int(duplicate.sum()), spans, sorted(set(origin.tolist()))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()))
        names = ["doc_id", "n_words", "n_repeat_words", "n_duplicate_words", "spans", "origins"]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return repeated_windows(docs, width, SparseSuffixes(width), answer, SCHEMA, id_col, text_col, every=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of every document that has one (see `repeated_passages` for nulls, repeats and ties)."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_words", "n_repeat_words", "n_duplicate_words", spans.alias("spans"), F.array_join(F.col("origins").cast("array<string>"), ",").alias("origins"))
