"""Second-order boosted trees by Spark rounds, over all rows: level-wise and leaf-wise, many models in lockstep.

Numbers are cut into bins once. A round grows every open node of every model by one level: the rows' tasks add up
gradients, second derivatives and counts by (model, node, feature, bin), in fixed-point numbers, so that sums are exact
whatever the partitions; other tasks add the partial sums of a (model, node) and name its best split; the driver
sees these only. A row's node follows from the trees so far, which are broadcast; its margin is written every few trees.
Inside a task features are columns; small ones are counted jointly, and a row's leaf is found by tables (`Leaves`).

A leaf-wise tree takes the splits with the largest gains among those that are open. A node's gain doesn't hang on the
order, so the tree is grown level by level to its depth and the best splits are taken afterwards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .features import levels_of
from .ranges import _count_below, medians, quantiles_of

#: Bins of a number, trees after which margins are written, the fixed-point unit of gradients, and histogram cells that a task holds at once.
BINS, WRITE_EVERY, UNIT, CELLS = 64, 8, 1 << 24, 1 << 22
#: Cells at most of features that are counted jointly, and of those that are looked up jointly in a tree.
COUNTED, LOOKED_UP = 512, 8192
#: Rows that a task of a round takes at least, if there are as many, and nodes that one names the splits of.
TASK_ROWS, TASK_NODES = 10_000, 64


@dataclass(frozen=True)
class Boost:
    """leaves = 0 keeps all splits down to `depth`; otherwise the best ones until there are `leaves`, never below `depth`.

    min_child bounds a child's sum of second derivatives, min_rows its rows; gamma is what a split must gain at least,
    lam the ridge on leaf values, positive the weight of positive rows. held: a fold whose rows the model doesn't see; made: whether it
    sees the rows that were made of the other folds (see `seen`).
    """

    trees: int = 20
    rate: float = 0.3
    depth: int = 4
    leaves: int = 0
    min_child: float = 5.0
    min_rows: int = 1
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    lam: float = 1.0
    positive: float = 1.0
    seed: int = 42
    held: int = -1
    made: bool = False


@dataclass
class Tree:
    """Node arrays, the root first; feature is -1 at leaves; rows with bin <= split go left."""

    feature: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, g: float, h: float, p: Boost) -> int:
        for column, v in zip((self.feature, self.split, self.left, self.right, self.value, self.cover, self.gain), (-1, 0, -1, -1, -p.rate * g / max(h + p.lam, 1e-12), h, 0.0), strict=True):
            column.append(v)
        return len(self.feature) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        feature, split, left, right = (np.array(c) for c in (self.feature, self.split, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= split[node], left[node], right[node])

    def add_to(self, margin: np.ndarray, x: np.ndarray) -> None:
        margin += np.array(self.value)[self.leaf_of(x)]


def _packs(sizes: list[int], most: int) -> list[list[int]]:
    """Features in packs whose joint cells are `most` at most (or a single feature's)."""
    out, cells = [], 0
    for f in sorted(range(len(sizes)), key=lambda f: (sizes[f], f)):
        if out and cells * sizes[f] <= most:
            out[-1].append(f)
            cells *= sizes[f]
        else:
            out.append([f])
            cells = sizes[f]
    return out


class Packed:
    """Rows of bins as joint cells: for each pack of features one column of numbers below the product of their sizes."""

    def __init__(self, sizes: list[int], most: int):
        self.sizes, self.packs = sizes, _packs(sizes, most)
        self.cells = [math.prod(sizes[f] for f in pack) for pack in self.packs]

    def columns(self, x: np.ndarray) -> list[np.ndarray]:
        """Bins from a feature's size on count as its last one."""
        out = []
        for pack in self.packs:
            code = np.zeros(len(x), np.intp)
            for f in pack:
                code *= self.sizes[f]
                code += np.minimum(x[:, f], self.sizes[f] - 1)
            out.append(code)
        return out


class Leaves:
    """A tree as tables: a row's cells strike out the leaves that it can't reach, the leftmost one left is its own."""

    def __init__(self, t: Tree, packed: Packed):
        order, left_of, stack = [], {}, [(0, False)]
        while stack:
            node, done = stack.pop()
            if t.feature[node] < 0:
                order.append(node)
            elif done:
                left_of[node] = (left_of[node][0], len(order))
            else:
                left_of[node] = (len(order), None)
                stack += [(t.right[node], False), (node, True), (t.left[node], False)]
        self.tree, self.tables = t, None
        if len(order) > 64:
            return
        self.kind, self.magic, bits = (np.uint16, 0x09AF, 16) if len(order) <= 16 else (np.uint64, 0x03F79D71B4CB0A89, 64)
        self.shift, every = bits - (bits.bit_length() - 1), (1 << bits) - 1
        # a lone bit times the magic number has a name of its own in its top bits
        self.node, self.value = np.zeros(bits, np.intp), np.zeros(bits)
        for i, node in enumerate(order):
            at = ((1 << i) * self.magic & every) >> self.shift
            self.node[at], self.value[at] = node, t.value[node]
        self.tables = []
        for i, pack in enumerate(packed.packs):
            if not any(t.feature[node] in pack for node in left_of):
                continue
            table = np.full(1, every, self.kind)
            for f in pack:
                own = np.full(packed.sizes[f], every, self.kind)
                for node, (lo, hi) in left_of.items():
                    if t.feature[node] == f:
                        own[t.split[node] + 1 :] &= self.kind(every ^ ((1 << hi) - (1 << lo)))
                table = np.bitwise_and.outer(table, own).ravel()
            self.tables.append((i, table))

    def _name(self, columns: list[np.ndarray]) -> np.ndarray | None:
        if not self.tables:
            return None
        (i, table), *more = self.tables
        m = table[columns[i]]
        for i, table in more:
            m &= table[columns[i]]
        m &= (~m) + self.kind(1)
        m *= self.kind(self.magic)
        m >>= self.kind(self.shift)
        return m.astype(np.intp)

    def of(self, columns: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        if self.tables is None:
            return self.tree.leaf_of(x)
        name = self._name(columns)
        return np.zeros(len(x), np.intp) if name is None else self.node[name]

    def add_to(self, margin: np.ndarray, columns: list[np.ndarray], x: np.ndarray) -> None:
        if self.tables is None:
            self.tree.add_to(margin, x)
        else:
            name = self._name(columns)
            margin += self.tree.value[0] if name is None else self.value[name]


@dataclass
class Model:
    """base: the margin before any tree."""

    base: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            t.add_to(out, x)
        return out

    def splits(self) -> list[tuple[int, int]]:
        return [(f, s) for t in self.trees for f, s in zip(t.feature, t.split, strict=True) if f >= 0]

    def gains(self) -> list[tuple[int, float, int]]:
        """(feature, mean gain of its splits, splits)."""
        every = [(f, g) for t in self.trees for f, g in zip(t.feature, t.gain, strict=True) if f >= 0]
        return [(f, float(np.mean(own)), len(own)) for f in sorted({f for f, _ in every}) for own in [[g for e, g in every if e == f]]]

    def shap(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Path-dependent attributions of the margin, and the mean margin they start from; together they sum to the margin."""
        phi, base = np.zeros(x.shape), self.base
        for t in self.trees:
            base += _tree_shap(t, x, phi)
        return phi, base


#: Folds from this number on hold made rows: those of fold MADE + f are for models that don't see fold f.
MADE = 1000


def seen(fold, held: int, made: bool):
    """Which rows a model sees: all but those of the fold held out, and made rows only if they are its own and it takes them."""
    return (fold != held) & (fold < MADE) | (fold == MADE + held) & made


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Binning:
    """Bins of encoded features: numbers by exact quantiles of the fitted rows (all values, if they are few), levels as 0 and 1 (first one dropped)."""

    numeric: list[str]
    categorical: list[str]
    bins: int = BINS

    def fit(self, d: DataFrame) -> Binning:
        middle = medians(d, self.numeric)
        rough = d.agg(*(F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(self.numeric))).first() if self.numeric else {}
        few = [c for i, c in enumerate(self.numeric) if rough[f"n{i}"] < 2 * self.bins]
        values = d.agg(*(F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(f"v{i}") for i, c in enumerate(few))).first() if few else {}
        cuts = {c: values[f"v{i}"] for i, c in enumerate(few) if len(values[f"v{i}"]) <= self.bins}
        many = [c for c in self.numeric if c not in cuts]
        if many:
            cuts |= {r["column_name"]: sorted(set(r["q"])) for r in quantiles_of(d, many, [i / self.bins for i in range(self.bins + 1)]).collect()}
        self.middle = {c: middle[c] if middle[c] is not None else 0.0 for c in self.numeric}
        self.edges = [cuts.get(c, [])[:-1] for c in self.numeric]
        self.levels = {c: levels_of(d, c)[1:] for c in self.categorical}
        self.names = [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{v}" for c, vs in self.levels.items() for v in vs]
        return self

    def encode(self, d: DataFrame, keep: list) -> DataFrame:
        """keep and mg_x, the array of bins; a missing number counts as the median."""
        own = [_count_below(F.coalesce(F.col(c).cast("double"), F.lit(self.middle[c])), e) for c, e in zip(self.numeric, self.edges, strict=True)]
        own += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, vs in self.levels.items() for v in vs]
        return d.select(*keep, F.array(*own).cast("array<int>").alias("mg_x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _uniform(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row of a tree: a hash of its key."""
    x = (key.astype(np.int64).view(np.uint64) + np.uint64(seed * 1_000_003 + tree)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _drawn(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree sees."""
    return _uniform(key, seed, tree) < share


def fit_models(rows: DataFrame, width: int, jobs: list[Boost], bins: int = BINS + 1) -> list[Model]:
    """A model for each job from rows (mg_key long, mg_y int, mg_fold int, mg_x): `width` features with fewer than `bins` bins.

    rows must be a written table. All models grow together; the driver holds the trees and a row for each (model, node) of a round.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tally = {(r.mg_fold, r.mg_y): r.n for r in rows.groupBy("mg_fold", "mg_y").agg(F.count("*").alias("n")).collect()}
    models = []
    for p in jobs:
        pos, neg = (sum(n for (fold, y), n in tally.items() if seen(fold, p.held, p.made) and y == k) for k in (1, 0))
        mean = min(max(pos * p.positive / max(pos * p.positive + neg, 1e-12), 1e-6), 1 - 1e-6)
        models.append(Model(math.log(mean / (1 - mean))))
    top = rows.agg(*(F.max(F.col("mg_x")[f]).alias(f"m{f}") for f in range(width))).first()  # a row
    sizes = [min(bins, (top[f"m{f}"] or 0) + 1) for f in range(width)]
    counted, looked_up = Packed(sizes, COUNTED), Packed(sizes, LOOKED_UP)
    tasks = max(1, -(-sum(tally.values()) // TASK_ROWS))
    state, written = rows.coalesce(tasks).withColumn("mg_m", F.array().cast("array<double>")), 0
    bases = [m.base for m in models]
    done: list = []  # for each finished tree that margins aren't written of a broadcast {job: Leaves}

    def margins(columns: list[np.ndarray], x: np.ndarray, before: np.ndarray | None, j: int, base: float, leaves: list[Leaves]) -> np.ndarray:
        out = np.full(len(x), base) if before is None else before[:, j].copy()
        for t in leaves:
            t.add_to(out, columns, x)
        return out

    def earlier(b: pa.RecordBatch, since: int) -> np.ndarray | None:
        return b.column("mg_m").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if since else None

    def grow(number: int, trees: dict[int, Tree], frontier: dict[int, list[int]], columns: dict[int, np.ndarray]):
        """The best split of each (job, node) as rows."""
        shared = sc.broadcast(({j: len(trees[j].feature) for j in frontier}, {j: Leaves(trees[j], looked_up) for j in frontier}, frontier, columns))
        since, before_now = written, tuple(done)

        def histograms(batches):
            length, now, open_nodes, cols = shared.value
            finished = [b.value for b in before_now]
            place = {j: np.full(length[j], len(nodes), np.intp) for j, nodes in open_nodes.items()}
            for j, nodes in open_nodes.items():
                place[j][nodes] = np.arange(len(nodes))
            asked = {j: [i for i, pack in enumerate(counted.packs) if not set(cols[j].tolist()).isdisjoint(pack)] for j in open_nodes}
            # a row that the model doesn't see, or at home in no open node, counts in a last node that is dropped
            sums = {(j, i): np.zeros((3, (len(nodes) + 1) * counted.cells[i]), np.int64) for j, nodes in open_nodes.items() for i in asked[j]}
            for b in batches:
                key, y, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mg_key", "mg_y", "mg_fold"))
                x = _matrix(b.column("mg_x"), width)
                code, look, before = counted.columns(x), looked_up.columns(x), earlier(b, since)
                own, draws = {}, {}
                for j, nodes in open_nodes.items():
                    p = jobs[j]
                    if (p.held, p.made) not in own:
                        own[p.held, p.made] = seen(fold, p.held, p.made)
                    used = own[p.held, p.made]
                    if p.subsample < 1:
                        if p.seed not in draws:
                            draws[p.seed] = _uniform(key, p.seed, number)
                        used = used & (draws[p.seed] < p.subsample)
                    at = np.where(used, place[j][now[j].of(look, x)], len(nodes))
                    q = sigmoid(margins(look, x, before, j, bases[j], [t[j] for t in finished]))
                    g, h = q - y, np.maximum(q * (1 - q), 1e-16)
                    if p.positive != 1:
                        w = np.where(y == 1, p.positive, 1.0)
                        g, h = g * w, h * w
                    g, h = np.rint(g * UNIT), np.rint(h * UNIT)
                    for i in asked[j]:
                        cell, s = at * counted.cells[i] + code[i], sums[j, i]
                        # exact: sums of whole numbers far below 2**53
                        s[0] += np.bincount(cell, g, s.shape[1]).astype(np.int64)
                        s[1] += np.bincount(cell, h, s.shape[1]).astype(np.int64)
                        s[2] += np.bincount(cell, minlength=s.shape[1])
            out = []
            for j, nodes in open_nodes.items():
                of = {}
                for i in asked[j]:
                    pack = counted.packs[i]
                    joint = sums[j, i].reshape(3, len(nodes) + 1, *(sizes[f] for f in pack))[:, :-1]
                    of |= {f: joint.sum(tuple(2 + k for k in range(len(pack)) if k != a)) for a, f in enumerate(pack)}
                flat = np.concatenate([of[f] for f in cols[j].tolist()], axis=2)
                out += [(j, node, flat[:, a].tobytes()) for a, node in enumerate(nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["job", "node", "body"])

        def choose(batches):
            cols, total = shared.value[3], {}
            for b in batches:
                for j, node, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    s = np.frombuffer(body, np.int64)
                    total.setdefault(j, {})[node] = total[j][node] + s if j in total and node in total[j] else s
            out = []
            for j, found in total.items():
                own = cols[j].tolist()
                place = np.concatenate([k * max(sizes) + np.arange(sizes[f]) for k, f in enumerate(own)])
                s = np.zeros((3, len(found), len(own) * max(sizes)), np.int64)
                s[:, :, place] = np.stack([v.reshape(3, -1) for v in found.values()], axis=1)
                best = _best(s.reshape(3, len(found), len(own), max(sizes)), jobs[j])
                out += [(j, node, own[f], *r) for node, (f, *r) in zip(found, best, strict=True)]
            kinds = (*[pa.int32()] * 3, pa.float64(), pa.int32(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

        names = ["job", "node", "feature", "gain", "bin", "gl", "hl", "nl", "g", "h", "n"]
        partial = state.mapInArrow(histograms, "job int, node int, body binary")
        kinds = ", ".join(f"{n} {k}" for n, k in zip(names, ["int"] * 3 + ["double", "int"] + ["long"] * 6, strict=True))
        few = min(parts, -(-sum(map(len, frontier.values())) // TASK_NODES))
        return partial.repartition(few, "job", "node").mapInArrow(choose, kinds).collect()

    for number in range(max((p.trees for p in jobs), default=0)):
        live = [j for j, p in enumerate(jobs) if p.trees > number]
        trees = {j: Tree() for j in live}
        columns = {}
        for j in live:
            rng = np.random.default_rng((jobs[j].seed, number))
            columns[j] = np.sort(rng.permutation(width)[: max(1, round(jobs[j].colsample * width))])
            trees[j].add(0.0, 0.0, jobs[j])
        frontier, level = {j: [0] for j in live}, 0
        while frontier:
            found = [r for part in _groups(frontier, sum(counted.cells)) for r in grow(number, trees, part, columns)]
            following: dict[int, list[int]] = {}
            for r in sorted(found, key=lambda r: (r.job, r.node)):
                j, node = r.job, r.node
                p, t = jobs[j], trees[j]
                if level == 0:
                    t.value[0], t.cover[0] = -p.rate * (r.g / UNIT) / max(r.h / UNIT + p.lam, 1e-12), r.h / UNIT
                if r.gain > 0 and level < p.depth:
                    t.feature[node], t.split[node], t.gain[node] = r.feature, r.bin, r.gain
                    t.left[node] = t.add(r.gl / UNIT, r.hl / UNIT, p)
                    t.right[node] = t.add((r.g - r.gl) / UNIT, (r.h - r.hl) / UNIT, p)
                    following.setdefault(j, []).extend((t.left[node], t.right[node]))
            level += 1
            frontier = {j: nodes for j, nodes in following.items() if level < jobs[j].depth}
        for j in live:
            models[j].trees.append(_budget(trees[j], jobs[j].leaves) if jobs[j].leaves else trees[j])
        done.append(sc.broadcast({j: Leaves(models[j].trees[-1], looked_up) for j in live}))
        if (number + 1) % WRITE_EVERY == 0 and number + 1 < max(p.trees for p in jobs):

            def write(batches, since=written, before_now=tuple(done)):
                finished = [b.value for b in before_now]
                for b in batches:
                    x = _matrix(b.column("mg_x"), width)
                    look, before = looked_up.columns(x), earlier(b, since)
                    every = np.column_stack([margins(look, x, before, j, bases[j], [t[j] for t in finished if j in t]) for j in range(len(bases))])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(bases), pa.int32()), pa.array(every.ravel(), pa.float64()))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], flat], names=b.schema.names)

            state = cut_lineage(state.mapInArrow(write, state.schema))
            written, done = number + 1, []
    return models


def _groups(frontier: dict[int, list[int]], cells: int) -> list[dict[int, list[int]]]:
    """The open nodes in groups of about CELLS histogram cells."""
    out, used = [{}], 0
    for j, nodes in frontier.items():
        for a in range(0, len(nodes), max(1, CELLS // cells)):
            part = nodes[a : a + max(1, CELLS // cells)]
            if used and used + len(part) * cells > CELLS:
                out.append({})
                used = 0
            out[-1].setdefault(j, []).extend(part)
            used += len(part) * cells
    return out


def _best(s: np.ndarray, p: Boost) -> list[tuple]:
    """For each node of sums (3, node, feature, bin): (feature, gain, bin, left G, H, n, all G, H, n) of its best split, of equal ones the first; gain -inf if none is allowed."""
    left, whole = np.cumsum(s, axis=3), s.sum(3)[..., None]
    right = whole - left
    score = lambda a: (a[0] / UNIT) ** 2 / np.maximum(a[1] / UNIT + p.lam, 1e-12)
    gain = 0.5 * (score(left) + score(right) - score(whole)) - p.gamma
    ok = (left[1] / UNIT >= p.min_child) & (right[1] / UNIT >= p.min_child) & (left[2] >= max(1, p.min_rows)) & (right[2] >= max(1, p.min_rows))
    gain = np.where(ok, gain, -np.inf).reshape(s.shape[1], -1)
    top = gain.argmax(1)
    return [(t // s.shape[3], float(gain[k, t]), t % s.shape[3], *left[:, k].reshape(3, -1)[:, t].tolist(), *whole[:, k, 0, 0].tolist()) for k, t in enumerate(top.tolist())]


def _budget(t: Tree, leaves: int) -> Tree:
    """The tree that takes the largest open gain first until it has `leaves`; of equal gains the node found first."""
    out, place = Tree(), {0: 0}

    def copy(node: int) -> int:
        for a, b in zip(vars(out).values(), vars(t).values(), strict=True):
            a.append(b[node])
        k = len(out.feature) - 1
        out.feature[k], out.left[k], out.right[k], out.gain[k] = -1, -1, -1, 0.0
        return k

    copy(0)
    for _ in range(leaves - 1):
        node = max((n for n in place if t.feature[n] >= 0), key=lambda n: (t.gain[n], -place[n]), default=None)
        if node is None:
            break
        k = place.pop(node)
        out.feature[k], out.gain[k] = t.feature[node], t.gain[node]
        out.left[k], out.right[k] = copy(t.left[node]), copy(t.right[node])
        place |= {t.left[node]: out.left[k], t.right[node]: out.right[k]}
    return out


def predict(rows: DataFrame, width: int, models: list[Model], held: list[int] | None = None) -> DataFrame:
    """(job, mg_key, mg_y, p) of every row by every model, or of the rows of the fold that the model hasn't seen."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    sizes = [1] * width
    for f, split in (fs for m in models for fs in m.splits()):
        sizes[f] = max(sizes[f], split + 2)
    packed = Packed(sizes, LOOKED_UP)

    def run(batches):
        leaves = [[Leaves(t, packed) for t in m.trees] for m in shared.value]
        for b in batches:
            x, fold = _matrix(b.column("mg_x"), width), b.column("mg_fold").to_numpy(zero_copy_only=False)
            of = {h: np.arange(len(x)) if h is None else np.flatnonzero(fold == h) for h in set(held or [None])}
            cells = {h: packed.columns(x[at]) for h, at in of.items()}
            for j, m in enumerate(shared.value):
                h = None if held is None else held[j]
                at = of[h]
                if len(at):
                    margin = np.full(len(at), m.base)
                    for t in leaves[j]:
                        t.add_to(margin, cells[h], x[at] if t.tables is None else x)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j), pa.int32()), b.column("mg_key").take(take), b.column("mg_y").take(take), pa.array(sigmoid(margin), pa.float64())], names=["job", "mg_key", "mg_y", "p"])

    return rows.mapInArrow(run, "job int, mg_key long, mg_y int, p double")


def attributions(rows: DataFrame, names: list[str], model: Model, key: str) -> DataFrame:
    """(key, feature, x, phi, base): path-dependent attributions of the margin, for every row; x is the bin; with base they sum to the margin."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = _matrix(part.column("mg_x"), len(names))
                phi, base = shared.value.shap(x)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({key: np.repeat(part.column("mg_key").to_numpy(), len(names)), "feature": names * len(x), "x": x.ravel().astype(float), "phi": phi.ravel(), "base": base}), preserve_index=False)

    return rows.select("mg_key", "mg_x").mapInArrow(run, f"`{key}` long, feature string, x double, phi double, base double")


def _tree_shap(t: Tree, b: np.ndarray, phi: np.ndarray) -> float:
    """Add one tree's attributions to phi; its mean value is returned.

    A leaf is reached through an interval of bins for each feature on its path. Which of these a row meets is a
    bit pattern; the attribution of each pattern is worked out once, from subset weights, and looked up for all rows.
    """
    base, stack = 0.0, [(0, {})]
    while stack:
        node, path = stack.pop()
        f = t.feature[node]
        if f >= 0:
            lo, hi, z = path.get(f, (-1, 1 << 30, 1.0))
            for child, bounds in ((t.left[node], (lo, min(hi, t.split[node]))), (t.right[node], (max(lo, t.split[node]), hi))):
                stack.append((child, path | {f: (*bounds, z * t.cover[child] / t.cover[node])}))
            continue
        v, m, feats = t.value[node], len(path), list(path)
        zero = np.array([path[f][2] for f in feats])
        base += v * zero.prod()
        if not m:
            continue
        bits = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
        pattern = np.zeros(len(b), np.int64)
        for k, f in enumerate(feats):
            pattern |= ((b[:, f] > path[f][0]) & (b[:, f] <= path[f][1])).astype(np.int64) << k
        for k, f in enumerate(feats):
            poly = np.zeros((1 << m, m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != k:
                    up = np.zeros_like(poly)
                    up[:, 1:] = poly[:, :-1] * bits[:, j : j + 1]
                    poly = poly * zero[j] + up
            phi[:, f] += (v * (poly @ weight) * (bits[:, k] - zero[k]))[pattern]
    return base
