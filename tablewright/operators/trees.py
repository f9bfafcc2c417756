"""Trees of many models grown side by side, in passes over the rows that serve all of them at once.

Rows are ``fold, label, x``. Model m leaves out the rows of fold ``held[m]``, so every fold of a cross validation and
every tree of a forest takes part in one pass. What a pass brings to the driver depends on models, nodes, columns, bins
and classes, never on rows. A finished ensemble is a few arrays; its plan of prediction does not grow with its trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.partials import matrix, totals
from ..session import written

BINS = 32
REWRITE = 10          # rounds of boosting after which the weights are written as a column again
PIECE = 1 << 21       # numbers held at once while rows meet all models
STRIP = 1 << 15       # of them, those that go down the trees together


def cut_points(rows: DataFrame, dims: int, bins: int = BINS) -> list[np.ndarray]:
    """Per column at most ``bins - 1`` values that part the rows into even shares (mergeable sketch, one pass)."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.select(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"c{i}") for i in range(dims)]).first()
    return [np.unique(np.array(found[i] or [], dtype=float)) for i in range(dims)]


def binned(rows: DataFrame, cuts: list[np.ndarray], models: int) -> DataFrame:
    """``fold, label, bins, w``: of each column how many cut points lie below the value, and a weight of 1 for each model."""
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1) if batch.num_rows else np.zeros((0, len(cuts)))
            ends = lambda width: pa.array(np.arange(batch.num_rows + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), batch.column("label"), pa.ListArray.from_arrays(ends(len(cuts)), pa.array(bins.ravel(), pa.int16())),
                 pa.ListArray.from_arrays(ends(models), pa.array(np.ones(batch.num_rows * models)))], ["fold", "label", "bins", "w"])
    return written(rows.select("fold", "label", "x").mapInArrow(run, "fold int, label double, bins array<short>, w array<double>"))


# ---- boosting ----------------------------------------------------------------------------------------------------------

@dataclass
class Small:
    """One tree of a fixed depth per model as a heap: inner nodes ask ``bins[feature] > cut``, leaves hold a value."""
    feature: np.ndarray         # models x inner nodes
    cut: np.ndarray             # bin number; the last bin sends all rows left
    value: np.ndarray           # models x leaves

    def leaves(self, m: int, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while len(node) and node[0] < self.feature.shape[1]:
            node = 2 * node + 1 + (bins[rows, self.feature[m, node]] > self.cut[m, node])
        return node - self.feature.shape[1]

    def predict(self, m: int, bins: np.ndarray) -> np.ndarray:
        return self.value[m, self.leaves(m, bins)]


def grow(rows: DataFrame, held: list[int], dims: int, depth: int, classes: int, weigh) -> tuple[Small, np.ndarray]:
    """One tree for every model over weighted rows, a pass per level; and the leaves' statistics (weights per class, or
    weight and weighted sum of labels if ``classes`` is 0)."""
    models, stats = len(held), classes or 2
    inner = (1 << depth) - 1
    tree = Small(np.zeros((models, inner), dtype=np.int64), np.full((models, inner), BINS), np.zeros((models, 1 << depth)))
    for level in range(depth):
        nodes = 1 << level
        part = Small(tree.feature[:, :nodes - 1], tree.cut[:, :nodes - 1], np.zeros((models, nodes)))

        def run(batch: pa.RecordBatch) -> np.ndarray:
            bins, y, fold = matrix(batch.column("bins")).astype(np.int64), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            out = np.zeros((models, nodes * dims * BINS * stats))
            w = weigh(batch, bins)
            for m, left_out in enumerate(held):
                mine = np.flatnonzero(fold != left_out)
                b, wm, ym = bins[mine], w[mine, m], y[mine]
                cell = ((part.leaves(m, b)[:, None] * dims + np.arange(dims)) * BINS + b) * stats
                if classes:
                    out[m] += np.bincount((cell + ym.astype(np.int64)[:, None]).ravel(), weights=np.repeat(wm, dims), minlength=out.shape[1])
                else:
                    out[m, ::2] += np.bincount(cell.ravel() // 2, weights=np.repeat(wm, dims), minlength=out.shape[1] // 2)
                    out[m, 1::2] += np.bincount(cell.ravel() // 2, weights=np.repeat(wm * ym, dims), minlength=out.shape[1] // 2)
            return out

        left = totals(rows, run, models * nodes * dims * BINS * stats).reshape(models, nodes, dims, BINS, stats).cumsum(axis=3)
        whole = left[:, :, :, -1:, :]
        right = whole - left
        size = (lambda s: s.sum(-1)) if classes else (lambda s: s[..., 0])
        gain = lambda s: (s ** 2).sum(-1) if classes else s[..., 1] ** 2           # over the weight: what is left is the impurity or variance
        a, b, total = size(left), size(right), size(whole)
        fine = (a > 1e-12 * total) & (b > 1e-12 * total)
        kept = np.where(fine, gain(left) / np.where(fine, a, 1) + gain(right) / np.where(fine, b, 1), -np.inf).reshape(models, nodes, dims * BINS)
        best = kept.argmax(axis=2)                                      # ties go to the first column and bin
        parted = np.isfinite(np.take_along_axis(kept, best[:, :, None], axis=2)[:, :, 0])
        at = slice(nodes - 1, 2 * nodes - 1)
        tree.feature[:, at] = np.where(parted, best // BINS, 0)
        tree.cut[:, at] = np.where(parted, best % BINS, BINS)
        if level == depth - 1:
            flat = left.reshape(models, nodes, dims * BINS, stats)
            low = np.take_along_axis(flat, np.broadcast_to(best[:, :, None, None], (models, nodes, 1, stats)), axis=2)[:, :, 0]
            low = np.where(parted[:, :, None], low, whole[:, :, 0, 0])
            leaves = np.stack([low, whole[:, :, 0, 0] - low], axis=2).reshape(models, 2 * nodes, stats)
    with np.errstate(invalid="ignore", divide="ignore"):
        tree.value = leaves.argmax(-1).astype(float) if classes else np.where(leaves[..., 0] > 0, leaves[..., 1] / leaves[..., 0], 0.0)
    return tree, leaves


@dataclass
class Boosted:
    """Per model a list of (tree, weight); model m uses ``trees[i]`` only while ``weights[i][m]`` is not 0."""
    cuts: list[np.ndarray]
    classes: int
    trees: list[Small] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def predict(self, df: DataFrame, m: int) -> DataFrame:
        """``id, label, prediction``: the class of most votes (ties to the least), or the weighted median."""
        cuts, classes = self.cuts, self.classes
        used = [i for i, w in enumerate(self.weights) if w[m] != 0]
        trees, votes = [self.trees[i] for i in used], np.array([self.weights[i][m] for i in used])

        def score(x: np.ndarray) -> np.ndarray:
            bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1)
            each = np.stack([t.predict(m, bins) for t in trees], axis=1) if trees else np.zeros((len(x), 0))
            if classes:
                total = np.zeros((len(x), classes))
                for i, v in enumerate(votes):
                    total[np.arange(len(x)), each[:, i].astype(np.int64)] += v
                return total.argmax(axis=1).astype(float)
            if not trees:
                return np.zeros(len(x))
            order = np.argsort(each, axis=1, kind="stable")
            reached = votes[order].cumsum(axis=1) >= votes.sum() / 2
            return np.take_along_axis(each, np.take_along_axis(order, reached.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
        return scored(df, score)


def scored(df: DataFrame, score) -> DataFrame:
    """``id, label, prediction`` where ``score`` maps a matrix of rows ``x`` to numbers."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(np.asarray(score(matrix(b.column("x"))), dtype=float))], ["id", "label", "prediction"])
    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "label", "x").mapInArrow(run, f"id {kind}, label double, prediction double")


class _Weights:
    """Weights of the rows: a written column and the rounds since."""

    def __init__(self, rows: DataFrame, models: int):
        self.rows, self.models, self.since = rows, models, []

    def now(self):
        since, models = list(self.since), self.models

        def weigh(batch: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
            w = matrix(batch.column("w")).copy()
            for factor in since:
                w *= factor(batch, bins)
            return w
        return weigh

    def add(self, factor, scale: np.ndarray) -> None:
        """One more round; after REWRITE of them the weights are written, over ``scale`` so that they stay near 1."""
        self.since.append(factor)
        if len(self.since) < REWRITE:
            return
        weigh, models = self.now(), self.models

        def run(batches):
            for b in batches:
                w = weigh(b, matrix(b.column("bins")).astype(np.int64)) / scale if b.num_rows else np.zeros((0, models))
                w = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * models, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("fold", "label", "bins")), w], ["fold", "label", "bins", "w"])
        self.rows, self.since = written(self.rows.mapInArrow(run, "fold int, label double, bins array<short>, w array<double>")), []


def boost_classes(rows: DataFrame, held: list[int], dims: int, classes: int, rounds: int, rate: float) -> Boosted:
    """SAMME with stumps (Hastie et al., 2009): a pass over the rows per round, for all models."""
    out, models = Boosted(cut_points(rows, dims), classes), len(held)
    state, open_, size = _Weights(binned(rows, out.cuts, models), models), np.ones(models, dtype=bool), None
    for i in range(rounds):
        tree, leaves = grow(state.rows, held, dims, 1, classes, state.now())
        total = leaves.sum(axis=(1, 2))
        error = 1 - leaves.max(axis=2).sum(axis=1) / np.where(total > 0, total, 1)
        exact, weak = error <= 1e-12, error >= 1 - 1 / classes
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = rate * (np.log((1 - error) / error) + np.log(classes - 1))
        alpha = np.where(exact, 1.0, np.where(weak, 1.0 if i == 0 else 0.0, alpha)) * open_       # a first stump always votes
        out.trees.append(tree)
        out.weights.append(alpha)
        open_ = open_ & ~exact & ~weak
        if not open_.any():
            break

        def factor(batch, bins, tree=tree, grow_by=np.where(open_, np.exp(alpha), 1.0)):
            y = batch.column("label").to_numpy()
            return np.stack([np.where(tree.predict(m, bins) != y, grow_by[m], 1.0) for m in range(models)], axis=1)
        size = np.maximum(total, 1e-300) if size is None else size
        state.add(factor, np.maximum(total, 1e-300) / size)
    return out


def boost_numbers(rows: DataFrame, held: list[int], dims: int, rounds: int, rate: float = 1.0, depth: int = 3) -> Boosted:
    """AdaBoost.R2 with linear loss (Drucker, 1997), for all models: a pass per level and one for the loss in each round."""
    out, models = Boosted(cut_points(rows, dims), 0), len(held)
    state, open_, size = _Weights(binned(rows, out.cuts, models), models), np.ones(models, dtype=bool), None
    for i in range(rounds):
        weigh = state.now()
        tree, leaves = grow(state.rows, held, dims, depth, 0, weigh)

        def gaps(batch, bins, tree=tree):
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            return np.stack([np.where(fold != left_out, np.abs(tree.predict(m, bins) - y), 0.0) for m, left_out in enumerate(held)], axis=1)

        def loss(batch):
            bins = matrix(batch.column("bins")).astype(np.int64)
            gap = gaps(batch, bins)
            return np.concatenate([(weigh(batch, bins) * gap).sum(axis=0), gap.max(axis=0)])

        lost, top = np.split(totals(state.rows, loss, models, models), 2)
        total, top = leaves[..., 0].sum(axis=1), np.maximum(top, 0)
        error = lost / np.where(top * total > 0, top * total, 1)
        exact, weak = top <= 0, error >= 0.5
        beta = np.clip(error, 1e-300, None) / (1 - np.where(weak, 0.5, error))
        alpha = np.where(exact, 1.0, np.where(weak, 1.0 if i == 0 else 0.0, rate * np.log(1 / beta))) * open_
        out.trees.append(tree)
        out.weights.append(alpha)
        open_ = open_ & ~exact & ~weak
        if not open_.any():
            break

        def factor(batch, bins, gaps=gaps, top=np.where(top > 0, top, 1), base=np.where(open_, beta, 1.0)):
            return base[None, :] ** (rate * (1 - np.minimum(1, gaps(batch, bins) / top)))
        size = np.maximum(total, 1e-300) if size is None else size
        state.add(factor, np.maximum(total, 1e-300) / size)
    return out


# ---- random cuts -------------------------------------------------------------------------------------------------------

def _digest(*keys) -> np.ndarray:
    """64-bit digests of integer keys, elementwise: equal keys draw equal numbers wherever and whenever they are asked for."""
    h = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
    return h


@dataclass
class Forest:
    """Trees of any shape as arrays by node; node m is the root of tree m. ``child`` is the first of two neighbours, or -1."""
    held: np.ndarray            # per tree: the fold it leaves out
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray           # nodes x classes (shares), or nodes x 1 (mean)

    def leaves(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Rows x trees: the node each row ends in. Rows pass in strips that stay in the processor's cache; a leaf leads to itself."""
        own = np.arange(len(self.child), dtype=np.int32)
        leaf = self.child < 0
        if leaf.all():
            return np.broadcast_to(trees, (len(x), len(trees))).copy()
        child, feature, cut = np.where(leaf, own, self.child).astype(np.int32), self.feature.astype(np.int32), np.where(leaf, np.inf, self.cut)
        out, step = np.empty((len(x), len(trees)), dtype=np.int32), max(1, STRIP // max(1, len(trees)))
        for i in range(0, len(x), step):
            part = np.ascontiguousarray(x[i:i + step])
            flat, start = part.ravel(), (np.arange(len(part), dtype=np.int32) * part.shape[1])[:, None]
            node = np.broadcast_to(trees.astype(np.int32), (len(part), len(trees)))
            while True:
                after = child[node] + (flat[start + feature[node]] > cut[node])
                if np.array_equal(after, node):
                    break
                node = after
            out[i:i + step] = node
        return out

    def predict(self, df: DataFrame, held: int) -> DataFrame:
        """``id, label, prediction`` of the trees that leave out fold ``held``: the class of the greatest mean share, or the mean."""
        trees = np.flatnonzero(self.held == held)

        def score(x: np.ndarray) -> np.ndarray:
            step = max(1, PIECE // (len(trees) * self.value.shape[1]))
            mean = np.concatenate([self.value[self.leaves(x[i:i + step], trees)].mean(axis=1) for i in range(0, len(x), step)])
            return mean.argmax(axis=1) if mean.shape[1] > 1 else mean[:, 0]
        return scored(df, score)


def random_cuts(rows: DataFrame, held: list[int], dims: int, classes: int, trees: int, depth: int, tried: int, seed: int) -> Forest:
    """Extremely randomised trees (Geurts et al., 2006): ``trees`` of them for every fold in ``held``, over ``fold, label, x``.

    Each open node draws ``tried`` columns from a digest of (seed, tree, path) and in each a threshold even between the
    node's least and greatest value; the best of them parts it. A node whose drawn columns are all constant draws the next ones,
    until none is left. A wave is two passes for all open nodes of all trees: ranges, then the statistics left of each
    threshold (rows per class; or rows, sum and sum of squares if ``classes`` is 0). Nodes of one class or value, of one row,
    or at ``depth`` are leaves. Memory follows trees times 2^depth, not the rows.
    """
    stats, n_trees = classes or 3, trees * len(held)
    owner = np.repeat(np.array(held), trees)
    forest = Forest(owner, np.zeros(n_trees, dtype=np.int64), np.zeros(n_trees), np.full(n_trees, -1), np.zeros((n_trees, classes or 1)))
    tree, path, level = np.tile(np.arange(trees), len(held)), np.ones(n_trees, dtype=np.uint64), np.zeros(n_trees, dtype=np.int64)
    whole, turn = np.zeros((n_trees, stats)), np.zeros(n_trees, dtype=np.int64)
    tried = min(tried, dims)
    every = 0 < dims == tried

    def statistics(y: np.ndarray) -> np.ndarray:
        return (y[:, None] == np.arange(classes)).astype(float) if classes else np.stack([np.ones(len(y)), y, y * y], axis=1)

    def meet(batch: pa.RecordBatch, spot: np.ndarray, use):
        """``use(x, y, slot, starts)`` on rows sorted by the slot of their node, in pieces; rows in closed nodes stay away.

        Where nodes try all columns a piece is one tree's: many rows of few nodes, and whole rows are copied. Sums depend on
        the pieces in their last digits, and so does the choice among cuts that part a node alike: few rows keep short ones."""
        x, y, fold = matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        least, great = max(1, PIECE // (n_trees * max(1, tried))), max(1, PIECE // max(n_trees, dims))
        short = np.uint16 if (spot >= 0).sum() <= 1 << 16 else np.int32         # short keys are sorted in linear time
        for left_out in np.unique(fold):
            mine, other = np.flatnonzero(fold == left_out), np.flatnonzero(owner != left_out)
            step = great if every and len(mine) > 8 * least else least
            for i in range(0, len(mine), step) if len(other) else ():
                some = mine[i:i + step]
                slots = spot[forest.leaves(x[some], other)]
                for slot in slots.T if every else [slots]:
                    r = np.nonzero(slot >= 0)
                    slot, r = slot[r], r[0]
                    if not len(r):
                        continue
                    order = np.argsort(slot.astype(short), kind="stable")
                    slot, r = slot[order], some[r[order]]
                    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                    use(x, y, r, slot, starts)

    def first(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(held), stats))
        y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        for k, left_out in enumerate(held):
            out[k] = statistics(y[fold != left_out]).sum(axis=0)
        return out

    whole[:] = np.repeat(totals(rows, first, len(held) * stats).reshape(len(held), stats), trees, axis=0)
    open_ = np.arange(n_trees)
    while len(open_):
        size = whole[open_].sum(1) if classes else whole[open_, 0]
        mixed = (whole[open_] > 0).sum(1) > 1 if classes else whole[open_, 2] - whole[open_, 1] ** 2 / np.maximum(size, 1) > 1e-12 * np.maximum(whole[open_, 2], 1e-300)
        open_ = open_[mixed & (size >= 2) & (level[open_] < depth) & (turn[open_] * tried < dims)]
        if not len(open_):
            break
        most = max(1, PIECE // (tried * max(stats, 2)))
        open_, later = open_[:most], open_[most:]               # so that what a pass brings together stays bounded
        slots = len(open_)
        keys = _digest(seed, tree[open_][:, None], path[open_][:, None], np.arange(dims)[None, :])
        columns = np.argsort(keys, axis=1, kind="stable")
        columns = np.concatenate([columns, columns[:, -1:].repeat(tried, axis=1)], axis=1)      # the last draw may be short
        columns = np.take_along_axis(columns, turn[open_][:, None] * tried + np.arange(tried)[None, :], axis=1)
        share = (_digest(seed + 1, tree[open_][:, None], path[open_][:, None], columns) >> np.uint64(11)).astype(float) / float(1 << 53)
        spot = np.full(len(forest.child), -1)
        spot[open_] = np.arange(slots)

        def ranges(batch: pa.RecordBatch) -> np.ndarray:
            out = np.full((2, slots, tried), -np.inf)

            def use(x, y, r, slot, starts):
                v, at = x.take(r, axis=0) if every else x[r[:, None], columns[slot]], slot[starts]
                out[0, at] = np.maximum(out[0, at], np.maximum.reduceat(v, starts, axis=0))
                out[1, at] = np.maximum(out[1, at], -np.minimum.reduceat(v, starts, axis=0))
            meet(batch, spot, use)
            return out

        high, low = totals(rows, ranges, 0, 2 * slots * tried).reshape(2, slots, tried)
        low = -low
        if every:       # from the order of the columns to the drawn one, in which the first of equal cuts is taken
            high, low = (np.take_along_axis(v, columns, axis=1) for v in (high, low))
        cut = low + share * (high - low)
        cut = np.where(cut >= high, low, cut)
        limit = cut
        if every:
            limit = np.empty_like(cut)
            np.put_along_axis(limit, columns, cut, axis=1)

        def left_of(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((slots, tried, stats))

            def use(x, y, r, slot, starts):
                v, s = x.take(r, axis=0) if every else x[r[:, None], columns[slot]], statistics(y[r])
                left = v <= limit.take(slot, axis=0)
                for k in range(stats):
                    out[slot[starts], :, k] += np.add.reduceat(left * s[:, k:k + 1], starts, axis=0)
            meet(batch, spot, use)
            return out

        left = totals(rows, left_of, slots * tried * stats).reshape(slots, tried, stats)
        if every:
            left = np.take_along_axis(left, columns[:, :, None], axis=1)
        right = whole[open_][:, None, :] - left
        a, b = (left.sum(-1), right.sum(-1)) if classes else (left[..., 0], right[..., 0])
        gain = lambda s: (s ** 2).sum(-1) if classes else s[..., 1] ** 2
        kept = np.where((high > low) & (a > 0) & (b > 0), gain(left) / np.maximum(a, 1) + gain(right) / np.maximum(b, 1), -np.inf)
        best = kept.argmax(axis=1)
        parted = np.isfinite(kept[np.arange(slots), best])
        turn[open_] += 1
        at, pick = open_[parted], (np.flatnonzero(parted), best[parted])
        new = len(forest.child) + 2 * np.arange(len(at))
        forest.feature[at], forest.cut[at], forest.child[at] = columns[pick], cut[pick], new
        two = lambda v, w: np.stack([v, w], axis=1).reshape(2 * len(at), *v.shape[1:])
        whole = np.concatenate([whole, two(left[pick], right[pick])])
        tree, level = np.concatenate([tree, two(tree[at], tree[at])]), np.concatenate([level, two(level[at] + 1, level[at] + 1)])
        path = np.concatenate([path, two(path[at] * np.uint64(2), path[at] * np.uint64(2) + np.uint64(1))])
        turn = np.concatenate([turn, np.zeros(2 * len(at), dtype=np.int64)])
        forest.feature = np.concatenate([forest.feature, np.zeros(2 * len(at), dtype=np.int64)])
        forest.cut = np.concatenate([forest.cut, np.zeros(2 * len(at))])
        forest.child = np.concatenate([forest.child, np.full(2 * len(at), -1)])
        open_ = np.concatenate([later, open_[~parted], two(new, new + 1)])
    size = np.maximum(whole.sum(1) if classes else whole[:, 0], 1e-300)
    forest.value = whole / size[:, None] if classes else (whole[:, 1] / size)[:, None]
    return forest
