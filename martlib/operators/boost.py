"""Boosted trees for many parameter sets and folds at once, one tree level per Spark job.

All models of a batch go down one level of their current tree together: every task holds a block
of rows for a group of models, sums gradients by (model, node, feature bin) and the sums are added
up by model across blocks; the best split of each node is chosen there, and only splits reach the
driver. Models of different depth do not wait for each other. What grows with the data (rows) stays
in the tasks; what a level moves is models x nodes x bins numbers, whatever the number of rows.

Boosting is second order on squared error: a node's value is soft(G, l1) / (H + l2), G the sum
of gradients and H the number of rows, a split's gain the difference of soft(G, l1)^2 / (H + l2)
between both children and the node. Columns are drawn once per tree, rows per tree by a hash of
their key, so results do not depend on how rows are dealt. Where one block holds all rows of a
fold (up to ``BLOCK_ROWS``) there is nothing to add up, and its task grows the same trees through
``ROUNDS`` rounds before it returns them; the models are spread over the tasks. Candidates of numeric features are
quantiles of the fold's own training rows; a category splits into one value against all others,
as its 0/1 column would.

Lost tasks are computed again from the training table and the trees, which the driver keeps; scores
of finished trees are held by the tasks as a cache and renewed every ``RENEW`` rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
# Trees of a model after which the cached scores take them in.
RENEW = 8
# Trees per model and job where no sums of other tasks are needed.
ROUNDS = 100
LEAST_GAIN = 1e-6
# Share by which gains must differ to count as different.
TIE = 1e-9

_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Table:
    """Names of the columns that a model is trained on."""

    numbers: list[str]
    categories: list[str]
    target: str
    day: str


@dataclass(frozen=True)
class Fold:
    """Training rows before ``test_from`` (None: all), tested from there to ``test_to``."""

    test_from: date | None = None
    test_to: date | None = None


@dataclass
class Layout:
    """Bins and split candidates of one fold's training rows."""

    edges: list[list[float]]
    names: list[list[str]]
    mean: float
    rows: int

    def __post_init__(self):
        widths = [len(e) + 1 for e in self.edges] + [len(n) + 1 for n in self.names]
        self.offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        self.bins = int(self.offsets[-1])
        p = len(self.edges)
        # Candidates in feature order: column, bin, number of the feature.
        numeric = [(c, b, c) for c in range(p) for b in range(len(self.edges[c]))]
        # The alphabetically first value of a category has no candidate of its own.
        single, feature = [], p
        for c, names in enumerate(self.names):
            for b in range(1, len(names)):
                single.append((p + c, b, feature))
                feature += 1
        self.features = feature
        self.numeric = len(numeric)
        self.column, self.bin, self.feature = np.array(numeric + single, np.int64).reshape(-1, 3).T
        most = max([len(e) + 1 for e in self.edges], default=1)
        self.padded = np.full((p, most), self.bins + 1, np.int64)
        for c in range(p):
            self.padded[c, : len(self.edges[c]) + 1] = np.arange(self.offsets[c], self.offsets[c + 1])

    def codes(self, numbers: np.ndarray, names: list[list[str]]) -> np.ndarray:
        """Each row's bin per column; unknown values of a category get its last one. Null is low."""
        out = np.empty((len(numbers), len(self.edges) + len(self.names)), np.int32)
        for c, edges in enumerate(self.edges):
            x = numbers[:, c]
            out[:, c] = np.where(np.isnan(x), 0, np.searchsorted(np.array(edges), x, side="right"))
        for c, known in enumerate(self.names):
            place = {name: i for i, name in enumerate(known)}
            out[:, len(self.edges) + c] = [place.get(x, len(known)) for x in names[c]]
        return out


@dataclass
class Tree:
    """A complete binary heap of nodes; a node without a split hands everything to its left."""

    depth: int
    column: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.column, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.gain, self.rows, self.value = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)

    def walk(self, codes: np.ndarray, numbers: int, levels: int) -> np.ndarray:
        """Heap place of each row after so many levels; ``numbers`` columns are ordered."""
        at = np.zeros(len(codes), np.int64)
        every = np.arange(len(codes))
        for _ in range(levels):
            column = self.column[at]
            code, limit = codes[every, column], self.bin[at]
            right = np.where(column < numbers, code > limit, code == limit) & (column >= 0)
            at = 2 * at + 1 + right
        return at


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(sums: np.ndarray, layout: Layout, allowed: np.ndarray, p) -> tuple:
    """Per node (best candidate or -1, gain, G, H, left G, left H) from sums by node and bin."""
    g, h = sums[..., 0], sums[..., 1]
    nodes = len(sums)
    zero = np.zeros((nodes, 1))
    total_g, total_h = g[:, -1:], h[:, -1:]

    def left(x, total):
        # Numeric candidates: all bins up to one; categories: everything but one bin.
        up = np.cumsum(np.concatenate([x, zero], axis=1)[:, layout.padded], axis=2)
        parts = [up[:, layout.column[: layout.numeric], layout.bin[: layout.numeric]]]
        at = layout.offsets[layout.column[layout.numeric :]] + layout.bin[layout.numeric :]
        parts.append(total - x[:, at])
        return np.concatenate(parts, axis=1)

    left_g, left_h = left(g, total_g), left(h, total_h)
    right_g, right_h = total_g - left_g, total_h - left_h

    def score(a, b):
        return soft(a, p.l1) ** 2 / (b + p.l2)

    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)
    fits = (left_h >= p.min_rows) & (right_h >= p.min_rows) & allowed[layout.feature] & (gain > LEAST_GAIN)
    gain = np.where(fits, gain, -1.0)
    if not gain.shape[1]:
        none = np.zeros(nodes)
        return np.full(nodes, -1), none, total_g[:, 0], total_h[:, 0], none, none
    # Splits that part the rows alike differ by rounding only; the first of them is taken.
    top = gain.max(axis=1, keepdims=True)
    best = np.argmax(gain >= top - TIE * np.abs(top), axis=1)
    every = np.arange(nodes)
    chosen = gain[every, best]
    return (
        np.where(chosen > 0, best, -1), chosen, total_g[:, 0], total_h[:, 0], left_g[every, best], left_h[every, best],
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def drawn_rows(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree is trained on, by a hash of their keys."""
    if share >= 1:
        return np.ones(len(keys), bool)
    salt = _mixed(np.array([seed * 1_000_003 + tree], np.uint64) * _GOLD)
    return (_mixed(keys ^ salt) >> np.uint64(11)) < np.uint64(int(share * 2**53))


def drawn_features(count: int, seed: int, tree: int, share: float) -> np.ndarray:
    allowed = np.zeros(count, bool)
    n = min(count, max(1, int(share * count + 1e-9)))
    allowed[np.random.default_rng([seed, tree]).permutation(count)[:n]] = True
    return allowed


class Block:
    """Some rows of one fold, for a group of models."""

    def __init__(self, codes, numbers, y, keys, train, tested, mean, models):
        self.codes, self.numbers, self.y, self.keys = codes, numbers, y, keys
        self.train, self.tested, self.mean, self.models = train, tested, mean, models
        self.scores: dict[int, np.ndarray] = {}
        self.drawn: tuple = (None,)

    def scored(self, model: int, trees: list[Tree]) -> np.ndarray:
        out = self.scores.get(model)
        out = np.full(len(self.y), self.mean) if out is None else out.copy()
        for tree in trees:
            out += tree.value[tree.walk(self.codes, self.numbers, tree.depth)]
        return out

    def renewed(self, trees: dict[int, list[Tree]]) -> "Block":
        new = Block(self.codes, self.numbers, self.y, self.keys, self.train, self.tested, self.mean, self.models)
        new.scores = {m: new.scored(m, trees[m]) for m in self.models}
        return new

    def sums(self, model: int, work, layout: Layout) -> np.ndarray:
        """Gradients and rows by node and bin for a model's next level; the last bin holds all."""
        p, trees, tree, level, number, allowed = work
        if self.drawn[0] != (model, number):
            rows = np.flatnonzero(self.train & drawn_rows(self.keys, p.seed, number, p.row_share))
            columns = np.unique(layout.column[allowed[layout.feature]])
            bins = np.full((len(rows), len(columns) + 1), layout.bins, np.int64)
            bins[:, :-1] = self.codes[np.ix_(rows, columns)] + layout.offsets[columns]
            gaps = self.y[rows] - self.scored(model, trees)[rows]
            self.drawn = (model, number), self.codes[rows], bins, np.repeat(gaps, bins.shape[1])
        _, codes, bins, g = self.drawn
        width = layout.bins + 1
        node = tree.walk(codes, self.numbers, level) - (2**level - 1)
        at, size = (bins + (node * width)[:, None]).ravel(), 2**level * width
        made = np.empty((size, 2))
        made[:, 0] = np.bincount(at, weights=g, minlength=size)
        made[:, 1] = np.bincount(at, minlength=size)
        return made.reshape(2**level, width, 2)

    def grow(self, model: int, grower: "Grower", rounds: int) -> list[Tree]:
        """Further trees of a model whose rows all stand in this block."""
        before = len(grower.trees)
        self.scores[model], grower.held = self.scored(model, grower.trees), before
        while len(grower.trees) < min(before + rounds, grower.p.trees):
            sums = self.sums(model, grower.work(), grower.layout)
            grower.grow(best_splits(sums, grower.layout, grower.allowed, grower.p))
            if len(grower.trees) > grower.held:
                self.scores[model] = self.scored(model, grower.trees[-1:])
                grower.held += 1
        return grower.trees[before:]


class Grower:
    """The state of one model: its finished trees and the one that grows."""

    def __init__(self, params, layout: Layout):
        self.p, self.layout, self.trees = params, layout, []
        self.held = 0  # finished trees that the cached scores have
        self.restart()

    def restart(self):
        self.tree, self.level = Tree(self.p.depth), 0
        self.allowed = drawn_features(self.layout.features, self.p.seed, len(self.trees), self.p.column_share)

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.p.trees

    def work(self):
        return self.p, self.trees[self.held :], self.tree, self.level, len(self.trees), self.allowed

    def grow(self, found: tuple) -> None:
        tree, p, layout = self.tree, self.p, self.layout
        first = 2**self.level - 1

        def value(g, h):
            return p.rate * soft(g, p.l1) / (h + p.l2)

        for i, (best, gain, g, h, left_g, left_h) in enumerate(zip(*found)):
            at = first + i
            if at and tree.column[(at - 1) // 2] < 0:
                # Under a node that was not split: its value goes down on the left.
                if at % 2:
                    tree.value[at], tree.rows[at] = tree.value[(at - 1) // 2], tree.rows[(at - 1) // 2]
                best = -1
            elif not at:
                tree.value[0], tree.rows[0] = value(g, h), int(h)
            if best >= 0:
                tree.column[at], tree.bin[at], tree.gain[at] = layout.column[best], layout.bin[best], gain
                for child, cg, ch in ((2 * at + 1, left_g, left_h), (2 * at + 2, g - left_g, h - left_h)):
                    tree.value[child], tree.rows[child] = value(cg, ch), int(ch)
            else:
                tree.value[2 * at + 1], tree.rows[2 * at + 1] = tree.value[at], tree.rows[at]
        self.level += 1
        if self.level == p.depth:
            self.trees.append(tree)
            self.restart()


def _day(value: date | None) -> int | None:
    return None if value is None else (value - date(1970, 1, 1)).days


def layout_of(train: DataFrame, table: Table, fold: Fold, bins: int) -> Layout:
    """Quantiles, category values and target mean of a fold's training rows; sizes of the model only."""
    rows = train if fold.test_from is None else train.filter(F.col(table.day) < F.lit(fold.test_from))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(table.numbers)],
        *[F.sort_array(F.collect_set(c)).alias(f"c{i}") for i, c in enumerate(table.categories)],
        F.avg(table.target).alias("mean"),
        F.count(table.target).alias("rows"),
    ).first()
    if not found["rows"]:
        raise ValueError("a fold has no training rows")
    edges = [sorted(set(found[f"q{i}"] or [])) for i in range(len(table.numbers))]
    return Layout(edges, [found[f"c{i}"] for i in range(len(table.categories))], found["mean"], found["rows"])


def _key(table: Table) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in (table.day, *table.categories)])


def _blocks(train: DataFrame, table: Table, folds: list[Fold], layouts: list[Layout], groups: list[tuple], parts: int):
    """(number, block) for every part of the rows and group of models of one fold."""
    day = F.datediff(F.col(table.day), F.lit("1970-01-01"))
    rows = train.repartition(parts, table.day, *table.categories).sortWithinPartitions(table.day, *table.categories)
    rows = rows.select(
        F.array(*[F.col(c).cast("double") for c in table.numbers]),
        F.array(*[F.col(c).cast("string") for c in table.categories]),
        F.col(table.target).cast("double"),
        day,
        _key(table),
    )
    spans = [(_day(f.test_from), _day(f.test_to)) for f in folds]

    def pack(part, records):
        records = list(records)
        if not records:
            return
        x, names, y, days, keys = zip(*records)
        x = np.array(x, np.float64).reshape(len(y), -1)
        names = [[r[c] for r in names] for c in range(len(names[0]))]
        y, days, keys = np.array(y, np.float64), np.array(days), np.array(keys, np.int64).view(np.uint64)
        coded = {}
        for number, (fold, models) in enumerate(groups):
            start, stop = spans[fold]
            if fold not in coded:
                held = np.ones(len(y), bool) if start is None else days <= stop
                coded[fold] = held, layouts[fold].codes(x[held], [list(np.array(n, object)[held]) for n in names])
            held, codes = coded[fold]
            train_rows = np.ones(held.sum(), bool) if start is None else days[held] < start
            tested = np.zeros(held.sum(), bool) if start is None else days[held] >= start
            made = Block(codes, len(layouts[fold].edges), y[held], keys[held], train_rows, tested, layouts[fold].mean, models)
            yield part * len(groups) + number, made

    count = parts * len(groups)
    return rows.rdd.mapPartitionsWithIndex(pack).partitionBy(count, lambda k: k).values()


def boost(
    train: DataFrame,
    table: Table,
    jobs: list[tuple[Fold, object]],
    bins: int,
    tree_counts: list[int] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> tuple[list[list[Tree]], list[Layout], dict]:
    """Trees of every (fold, parameters), their layouts, and with ``tree_counts`` the mean absolute
    error on the fold's test rows by (job, number of trees)."""
    sc = train.sparkSession.sparkContext
    parts = max(1, math.ceil(train.count() / block_rows))
    folds = list(dict.fromkeys(fold for fold, _ in jobs))
    layouts = [layout_of(train, table, fold, bins) for fold in folds]
    numbers = {fold: [m for m, (f, _) in enumerate(jobs) if f == fold] for fold in folds}
    # So many groups of models that every core has a block, however few rows there are.
    size = max(1, math.ceil(len(jobs) * parts / (2 * sc.defaultParallelism)))
    groups = [(i, tuple(numbers[f][a : a + size])) for i, f in enumerate(folds) for a in range(0, len(numbers[f]), size)]
    raw = _blocks(train, table, folds, layouts, groups, parts).persist()
    growers = [Grower(p, layouts[folds.index(fold)]) for fold, p in jobs]
    shared, where = sc.broadcast(layouts), [folds.index(fold) for fold, _ in jobs]
    held, tasks = raw, min(len(jobs), 2 * sc.defaultParallelism)
    try:
        while parts == 1 and not all(g.done for g in growers):
            state = sc.broadcast(growers)

            def alone(block, state=state):
                return [(m, block.grow(m, state.value[m], ROUNDS)) for m in block.models]

            for m, trees in raw.flatMap(alone).collect():
                growers[m].trees += trees
                growers[m].restart()
            state.destroy()
        while not all(g.done for g in growers):
            if any(len(g.trees) - g.held >= RENEW for g in growers if not g.done):
                held = _renew(sc, raw, held, growers)
            work = sc.broadcast({m: g.work() for m, g in enumerate(growers) if not g.done})

            def sums(block, work=work):
                for m in block.models:
                    if m in work.value:
                        yield m, block.sums(m, work.value[m], shared.value[where[m]])

            def best(pair, work=work):
                m, total = pair
                p, _, _, _, _, allowed = work.value[m]
                return m, best_splits(total, shared.value[where[m]], allowed, p)

            for m, found in held.flatMap(sums).reduceByKey(np.add, tasks).map(best).collect():
                growers[m].grow(found)
            work.destroy()
        errors = _errors(sc, raw, growers, tree_counts) if tree_counts else {}
    finally:
        held.unpersist()
        raw.unpersist()
        shared.destroy()
    return [g.trees for g in growers], [g.layout for g in growers], errors


def _renew(sc, raw, held, growers: list[Grower]):
    """Blocks whose cached scores have all finished trees, from the blocks without any."""
    trees = sc.broadcast({m: list(g.trees) for m, g in enumerate(growers)})
    new = raw.map(lambda block: block.renewed(trees.value)).persist()
    new.count()
    for g in growers:
        g.held = len(g.trees)
    if held is not raw:
        held.unpersist()
    return new


def _errors(sc, raw, growers: list[Grower], counts: list[int]) -> dict:
    trees = sc.broadcast([g.trees for g in growers])

    def gaps(block):
        for m in block.models:
            score, y = np.full(len(block.y), block.mean), block.y[block.tested]
            for n, tree in enumerate(trees.value[m], 1):
                score += tree.value[tree.walk(block.codes, block.numbers, tree.depth)]
                if n in counts:
                    yield (m, n), np.array([np.abs(y - score[block.tested]).sum(), len(y)])

    sums = raw.flatMap(gaps).reduceByKey(np.add, min(len(growers), 2 * sc.defaultParallelism)).collect()
    trees.destroy()
    return {key: float(total / n) for key, (total, n) in sums if n}
