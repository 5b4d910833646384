"""Substring deduplication by recompression.

A text's words are renamed level by level: first runs of one word, then pairs of
neighbours, where the left name falls in one half of all names and the right one
in the other. A name is a fingerprint of what its symbol stands for, so it is the
same wherever these words stand, on any executor. Each symbol carries its context:
the words that force it to form, so equal windows hold equal symbols wherever a
context lies inside them.

Each level is a Spark round: the homes of the documents ask for the names that
form on it, and are told which of them occur again anywhere. A name built on one
that doesn't can't occur again and isn't asked for. A window that holds a symbol
that doesn't occur again is no repeat; any other one is shown under its highest
symbol, the first one of that level, and equal windows are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import flat, mix, owner, runs, sha, spread, word_spans
from .repeats import Shown, Told, covered, repeated_windows

#: Words of a window, and levels of pairing; a symbol of the next level would rarely have its context inside a window.
WINDOW, LEVELS = 20, 3


class Level(NamedTuple):
    """Symbols in order: name, the words [start, end) of the context, whether the name forms on this level, and
    its parts among the symbols of the level below (a symbol that is passed on has one, twice).

    Context bounds just outside a text mean that the text's edge took part.
    """

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray


def recompress(h: np.ndarray, w_off: np.ndarray, levels: int = LEVELS) -> Iterator[Level]:
    """The levels, lowest first: runs, then `levels` rounds of pairs."""
    n = len(h)
    inner = w_off[:-1][np.diff(w_off) > 0]
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[inner], tail[w_off[1:][np.diff(w_off) > 0] - 1] = True, True
    # Runs: a maximal run of one word is one symbol; each symbol must see that its neighbours differ.
    new = head.copy()
    new[1:] |= h[1:] != h[:-1]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    last = first + length - 1
    name = np.where(length > 1, mix(h[first] + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), h[first])
    cs, ce = first - 1, last + 2
    head, tail = head[first], tail[last]
    yield Level(name, cs, ce, length > 1, first, first)
    for level in range(levels):
        m = len(name)
        side = (mix(name + np.uint64(level + 1)) >> np.uint64(63)) == 1  # True: may be the left one of a pair
        left = np.zeros(m, bool)
        left[:-1] = side[:-1] & ~side[1:] & ~tail[:-1]
        right = np.zeros(m, bool)
        right[1:] = left[:-1]
        keep = np.flatnonzero(~right)
        pair = left[keep]
        follow = np.minimum(keep + 1, m - 1)
        merged = mix(name[keep] * np.uint64(0xD6E8FEB86659FD93) + mix(name[follow]) + np.uint64(level))
        # A single left-hand symbol saw its right neighbour, a single right-hand one its left neighbour.
        before = np.maximum(keep - 1, 0)
        low = np.where(side[keep], cs[keep], np.where(head[keep], cs[keep] - 1, cs[before]))
        high = np.where(pair, ce[follow], np.where(side[keep], np.where(tail[keep], ce[keep] + 1, ce[follow]), ce[keep]))
        head, tail = head[keep], np.where(pair, tail[follow], tail[keep])
        name = np.where(pair, merged, name[keep])
        cs, ce = np.minimum(low, cs[keep]), np.maximum(high, ce[keep])
        yield Level(name, cs, ce, pair, keep, np.where(pair, follow, keep))


class Symbols:
    """Names are those of recompression; each level is a round."""

    rounds, suffix = LEVELS, 0

    @staticmethod
    def _judged(h: np.ndarray, w_off: np.ndarray, told: Told, turn: int) -> Iterator[tuple[Level, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, live, hot, new): live symbols occur again, as far as the rounds before `turn` tell; new: where those stand that it asks for."""
        live, hot = np.ones(len(h), bool), np.zeros(len(h), bool)
        for number, level in enumerate(recompress(h, w_off, min(turn + 1, LEVELS))):
            built, hot = live[level.left] & live[level.right], hot[level.left]
            asked = max(0, number - 1)  # runs and the first pairs are asked for together
            new = np.flatnonzero(built & level.made)
            live = built
            if asked < turn:
                live[new], hot[new] = told.find(level.name[new])
            yield level, live, hot, new if asked == turn else new[:0]

    def ask(self, h: np.ndarray, w_off: np.ndarray, width: int, told: Told, turn: int) -> np.ndarray:
        return np.concatenate([level.name[new] for level, _, _, new in self._judged(h, w_off, told, turn)])

    def show(self, h: np.ndarray, w_off: np.ndarray, width: int, told: Told) -> Shown:
        """Each window that holds no dead symbol, under the first of its symbols of the highest level.

        Contexts begin and end in the order of the symbols, so the first symbol that begins inside a window either
        lies in it or no symbol of its level does. Words are symbols too, so every window has one.
        """
        n, size = len(h), len(h) - width + 1
        z = np.zeros(0, np.int64)
        if size <= 0:
            return Shown(z.astype(np.uint64), z, z, z, z.astype(bool))
        text, window = owner(w_off, n), np.arange(size)
        name, at, heat, rank = h[:size].copy(), window.copy(), np.zeros(size, bool), np.zeros(size, np.int64)
        dead = np.zeros(size + 1, np.int64)
        for number, (level, live, hot, _) in enumerate(self._judged(h, w_off, told, self.rounds)):
            ok = np.flatnonzero((level.start >= 0) & (level.end <= n) & (level.end - level.start <= width))
            ok = ok[text[level.start[ok]] == text[level.end[ok] - 1]]
            if not len(ok):
                continue
            start, end = level.start[ok], level.end[ok]
            gone = ~live[ok]
            lo, hi = np.maximum(end[gone] - width, 0), np.minimum(start[gone], size - 1) + 1
            np.add.at(dead, lo[lo < hi], 1)
            np.add.at(dead, hi[lo < hi], -1)
            # the first symbol that begins at the window's start or later
            j = np.cumsum(np.bincount(start + 1, minlength=n + 1))[:size]
            j = np.minimum(j, len(ok) - 1)
            inside = np.flatnonzero((start[j] >= window) & (end[j] <= window + width))
            k = ok[j[inside]]
            name[inside], at[inside], heat[inside], rank[inside] = level.name[k], level.start[k], hot[k], number + 1
        # One symbol may be the highest of windows on two levels: the level is part of the place.
        good = (text[:size] == text[width - 1 :]) & (np.cumsum(dead)[:size] == 0)
        _, _, first, count = by_position(name, at * (LEVELS + 2) + rank, good)
        return Shown(name[first], at[first], first, count, heat[first])


def sliding_max(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of every `width` consecutive entries and where it first stands, by doubling."""
    at, done = np.arange(len(x)), 1
    while done < width:
        step = min(done, width - done)
        right = x[step:] > x[: len(x) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        x = np.maximum(x[: len(x) - step], x[step:])
        done += step
    return x, at


def by_position(value: np.ndarray, where: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows with one name in one place, as (name, place, first window, windows)."""
    ok = np.flatnonzero(inside)
    first, count = runs(ok, where[ok])
    return mix(value[ok[first]]), where[ok[first]], ok[first], count


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove each word covered by a window whose words also start earlier; windows are judged on the input.

    One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked
    for, the kept words joined by spaces. Null, empty and short texts lose nothing.
    Rows that share an id are one document with several texts, each with a row of its own: equal starts aren't earlier
    than each other, so copies of a row keep their words. A null id comes after all others. Other columns aren't read;
    texts are taken whole, and a word may be of any length. An empty table gives no row.
    """

    def answer(left: pa.Table, found) -> pa.Table:
        text = left.column("text").combine_chunks()
        data, off = flat(text)
        s, e, w_off = word_spans(data, off)
        n_words = np.diff(w_off)
        removed, digests, kept = [], [], []
        for i, (lo, n, _, _) in enumerate(found):
            a, b = w_off[i], w_off[i + 1]
            ss, ee = s[a:b], e[a:b]
            if len(lo):
                gone = covered(lo, n, width, b - a)
                ss, ee = ss[~gone], ee[~gone]
            words = _join(data, ss, ee)
            removed.append(int(n_words[i]) - len(ss))
            digests.append(sha(words))
            kept.append(words.decode() if with_text else None)
        return pa.table([left.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return repeated_windows(docs, width, Symbols(), answer, SCHEMA, id_col, text_col)


def _join(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """The spans joined by one space."""
    if not len(s):
        return b""
    n = e - s
    out = np.full(int(n.sum()) + len(s) - 1, 0x20, np.uint8)
    out[spread(np.append(0, np.cumsum(n + 1)[:-1]), n)] = data[spread(s, n)]
    return out.tobytes()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document (see `remove_repeats` for nulls, repeats and ties)."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
