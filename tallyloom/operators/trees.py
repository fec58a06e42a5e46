"""Regression trees and boosted trees of all keys at once, by histograms of binned features.

Rows of a key are binned per feature; a level of a tree is decided from the sums of the label per
(node, feature, bin). Keys of at most HELD rows are fitted whole in the task that gets them, all in
one job. Longer keys are never brought together: each level adds up the histograms of all tasks,
one small row per key, and decides from them. Both ways use the same cuts and the same choice.

Splits are those of variance reduction: the greatest gain, of equal gains the first feature, then
the lowest cut. A node without gain stays a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import written

#: Rows of a key that one task may hold.
HELD = 200_000
#: Ranks at which the values of a longer key are read to place its cuts.
RANKS = 1024
#: Entries of the histograms that a task holds before it hands them on.
ENTRIES = 1 << 20
TREE = "struct<rate: double, feature: array<int>, threshold: array<double>, value: array<double>, weight: array<double>>"


def cut_points(values: np.ndarray, counts: np.ndarray, bins: int) -> list[float]:
    """At most ``bins - 1`` cuts between neighbouring values: all, or those nearest to equal shares."""
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle.tolist()
    stride = counts.sum() / bins
    out, target, seen = [], stride, counts[0]
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins of the columns of ``x``; a value equal to a cut lies below it."""
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(cuts) else x


class Growing:
    """A tree under construction: nodes as in a heap, the root is 1. ``total``: count, sum and sum of squares."""

    def __init__(self, cuts: list[list[float]], depth: int):
        size = 2 << depth
        self.cuts, self.depth, self.bins = cuts, depth, max(map(len, cuts), default=0) + 1
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)
        self.value, self.weight = np.zeros(size), np.zeros(size)
        self.active = [1]

    def histograms(self, codes: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sums as [active node, feature, bin, measure] from codes of (node, feature, bin)."""
        out = np.zeros((len(self.active) * len(self.cuts) * self.bins, 3))
        np.add.at(out, codes, sums)
        return out.reshape(len(self.active), len(self.cuts), self.bins, 3)

    def decide(self, hist: np.ndarray) -> None:
        """Split the active nodes by their histograms; their children become active."""
        total = hist[:, 0].sum(axis=1)
        left = np.cumsum(hist, axis=2)[:, :, :-1]
        right = total[:, None, None] - left

        def impurity(part: np.ndarray) -> np.ndarray:
            n = np.maximum(part[..., 0], 1)
            return (part[..., 2] - part[..., 1] ** 2 / n) / n

        whole = impurity(total)
        n = np.maximum(total[:, 0], 1)[:, None, None]
        gain = whole[:, None, None] - left[..., 0] / n * impurity(left) - right[..., 0] / n * impurity(right)
        known = np.arange(self.bins - 1) < np.array([[len(c)] for c in self.cuts])
        gain = np.where(known & (left[..., 0] > 0) & (right[..., 0] > 0), gain, -np.inf)
        children = []
        for i, node in enumerate(self.active):
            if total[i, 0]:
                self.value[node] = total[i, 1] / total[i, 0]
            if not gain[i].size or not gain[i].max() > 0:
                continue
            f, b = np.unravel_index(np.argmax(gain[i]), gain[i].shape)
            self.feature[node], self.bin[node] = f, b
            self.weight[node] = gain[i, f, b] * total[i, 0]
            for child, part in ((2 * node, left), (2 * node + 1, right)):
                self.value[child] = part[i, f, b, 1] / part[i, f, b, 0]
                children.append(child)
        self.active = children

    def done(self, rate: float) -> dict:
        inner = self.feature >= 0
        cut = [self.cuts[f][b] if f >= 0 else 0.0 for f, b in zip(self.feature, self.bin, strict=True)]
        return {
            "rate": rate,
            "feature": self.feature.tolist(),
            "threshold": cut,
            "value": self.value.tolist(),
            "weight": np.where(inner, self.weight, 0.0).tolist(),
        }


def codes_of(node: np.ndarray, bins: np.ndarray, width: int, active: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in active nodes and their codes of (node, feature, bin), features side by side."""
    place = np.full(int(max(active, default=0)) + 1, -1)
    place[active] = np.arange(len(active))
    slot = np.where(node < len(place), place[np.minimum(node, len(place) - 1)], -1)
    rows = np.flatnonzero(slot >= 0)
    d = bins.shape[1]
    return rows, ((slot[rows, None] * d + np.arange(d)) * width + bins[rows])


def fit_rows(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int, bins: int) -> list[dict]:
    """The trees of one key whose rows are at hand; ``rounds`` 0 gives a single plain tree."""
    cuts = [cut_points(*np.unique(x[:, f], return_counts=True), bins) for f in range(x.shape[1])]
    own, out, target = binned(x, cuts), [], y
    guess = np.zeros(len(y))
    for r in range(max(rounds, 1)):
        tree, node = Growing(cuts, depth), np.ones(len(y), np.int64)
        for _ in range(depth):
            if not tree.active:
                break
            rows, codes = codes_of(node, own, tree.bins, tree.active)
            t = np.repeat(target[rows], own.shape[1])
            tree.decide(tree.histograms(codes.ravel(), np.stack([np.ones_like(t), t, t * t], axis=1)))
            f = tree.feature[node]
            moved = f >= 0
            node[moved] = 2 * node[moved] + (own[np.flatnonzero(moved), f[moved]] > tree.bin[node[moved]])
        weight = rate if r else 1.0
        out.append(tree.done(weight))
        guess += weight * tree.value[node]
        target = 2 * (y - guess)
    return out


def fit(
    df: DataFrame, key: str, label: str, features: list[str], rounds: int = 0, rate: float = 0.1, depth: int = 5, bins: int = 32
) -> DataFrame:
    """(key, trees): the model of every key; ``rounds`` > 0 boosts that many trees on the residuals.

    Rows with a null or NaN in the key, label or a feature are left out; a key without rows has no model.
    """
    kind = dict(df.dtypes)[key]
    wide = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    rows = df.na.drop("any", subset=[key, label, *features]).select(F.col(key), F.col(label).cast("double").alias("y"), wide)
    rows = rows.filter(~F.isnan("y") & ~F.exists("x", F.isnan))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HELD)
    long = written(sizes, "long-keys")
    any_long = long.limit(1).count() > 0
    few = rows.join(long, key, "left_anti") if any_long else rows

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit_rows(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float), rounds, rate, depth, bins)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "trees": [found]})

    models = few.groupBy(key).applyInPandas(whole, f"{key} {kind}, trees array<{TREE}>")
    if any_long:
        models = models.unionByName(fit_long(rows.join(long.select(key), key), key, kind, len(features), rounds, rate, depth, bins))
    return written(models, "trees")


def fit_long(
    rows: DataFrame, key: str, kind: str, width: int, rounds: int, rate: float, depth: int, bins: int
) -> DataFrame:
    """The same for keys whose rows stay spread: cuts from RANKS ranks, a level for each pass."""
    ranks = [i / RANKS for i in range(RANKS + 1)]
    seen = rows.groupBy(key).agg(
        *[F.percentile_approx(F.col("x")[f], ranks, 10 * RANKS).alias(f"f{f}") for f in range(width)]
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [
                [cut_points(*np.unique(np.asarray(row[f"f{f}"], float), return_counts=True), bins) for f in range(width)]
                for _, row in b.iterrows()
            ]
            yield pd.DataFrame({key: b[key], "cuts": lists})

    cuts = written(seen.mapInPandas(place, f"{key} {kind}, cuts array<array<double>>"), "cuts")
    bin_of = F.transform("x", lambda x, i: F.size(F.filter(F.col("cuts")[i], lambda c: c < x)))
    own = rows.join(cuts, key).select(key, "y", bin_of.alias("bins"), F.lit(0.0).alias("guess"))
    own = written(own, "binned")
    state = cuts.select(
        key, "cuts", F.array().cast(f"array<{TREE}>").alias("trees"), *[F.lit(None).cast(t).alias(c) for c, t in GROWN.items()]
    )
    for r in range(max(rounds, 1)):
        for _ in range(depth):
            target = F.col("y") if r == 0 else 2 * (F.col("y") - F.col("guess"))
            at = own.join(state.select(key, "feature", "bin", "active"), key)
            at = at.select(key, "bins", target.alias("y"), reached("feature", "bin", "bins", depth).alias("node"), F.coalesce("active", F.array(F.lit(1))).alias("active"))
            sums = at.mapInPandas(partial_sums(key, width, bins), f"{key} {kind}, codes array<bigint>, sums array<double>")
            state = sums.groupBy(key).cogroup(state.groupBy(key)).applyInPandas(level(key, depth, width, bins), state.schema)
            state = written(state, "level")
        weight = rate if r else 1.0
        found = own.join(state.select(key, "feature", "bin", "value"), key)
        gain = F.lit(weight) * F.col("value")[reached("feature", "bin", "bins", depth)]
        if r + 1 < rounds:
            own = written(found.select(key, "y", "bins", (F.col("guess") + gain).alias("guess")), "binned")
        state = written(state.groupBy(key).applyInPandas(finished(key, depth, weight), state.schema), "tree")
    return state.select(key, "trees")


#: A tree that is growing, as columns; null before its first level.
GROWN = {"feature": "array<int>", "bin": "array<int>", "value": "array<double>", "weight": "array<double>", "active": "array<int>"}


def reached(feature: str, cut: str, bins: str, depth: int) -> Column:
    """The heap number of the node a row has come to; 1 where no tree is yet."""
    def down(node: Column, _: Column) -> Column:
        f = F.col(feature)[node]
        right = (F.col(bins)[f] > F.col(cut)[node]).cast("int")
        return F.when(f >= 0, 2 * node + right).otherwise(node)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down)
    return F.when(F.col(feature).isNull(), F.lit(1)).otherwise(walked)


def partial_sums(key: str, width: int, bins: int):
    """Histograms of a task's rows, one row per key and time that the task hands them on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            names = list(held)
            merged = {n: np.unique(np.concatenate([c for c, _ in held[n]]), return_inverse=True) for n in names}
            sums = {n: np.zeros((len(merged[n][0]), 3)) for n in names}
            for n in names:
                np.add.at(sums[n], merged[n][1], np.concatenate([s for _, s in held[n]]))
            return pd.DataFrame({key: names, "codes": [merged[n][0] for n in names], "sums": [sums[n].ravel() for n in names]})

        size = 0
        for b in batches:
            for name, own in b.groupby(key, sort=False):
                rows, codes = codes_of(
                    own["node"].to_numpy(np.int64), np.stack(own["bins"].to_numpy()), bins, list(own["active"].iloc[0])
                )
                t = np.repeat(own["y"].to_numpy(float)[rows], width)
                cells, inverse = np.unique(codes.ravel(), return_inverse=True)
                sums = np.zeros((len(cells), 3))
                np.add.at(sums, inverse, np.stack([np.ones_like(t), t, t * t], axis=1))
                held.setdefault(name, []).append((cells, sums))
                size += len(cells)
            if size > ENTRIES:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return run


def resumed(row: pd.Series, depth: int) -> Growing:
    tree = Growing([list(c) for c in row["cuts"]], depth)
    if row["feature"] is not None:
        for name in ("feature", "bin", "value", "weight"):
            getattr(tree, name)[:] = row[name]
        tree.active = list(row["active"])
    return tree


def saved(state: pd.DataFrame, tree: Growing) -> pd.DataFrame:
    cells = {c: [np.asarray(getattr(tree, c)).tolist()] for c in GROWN}
    return state.iloc[:1].assign(**{c: pd.Series(v, index=state.index[:1], dtype=object) for c, v in cells.items()})


def level(key: str, depth: int, width: int, bins: int):
    """One level of the tree of one key, from the histograms of all tasks."""

    def run(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        tree = resumed(state.iloc[0], depth)
        if tree.active and len(sums):
            hist = np.zeros((len(tree.active) * width * bins, 3))
            for codes, own in zip(sums["codes"], sums["sums"], strict=True):
                np.add.at(hist, np.asarray(codes, np.int64), np.asarray(own, float).reshape(-1, 3))
            tree.decide(hist.reshape(len(tree.active), width, bins, 3)[:, :, : tree.bins])
        return saved(state, tree)

    return run


def finished(key: str, depth: int, rate: float):
    def run(state: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        trees = [*row["trees"], resumed(row, depth).done(rate)]
        out = state.iloc[:1].assign(trees=pd.Series([trees], index=state.index[:1], dtype=object))
        return out.assign(**{c: None for c in GROWN})

    return run


def predict(df: DataFrame, models: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The rows of keys that have a model, with ``prediction``; null where a feature is null."""
    x = F.array(*[F.col(f).cast("double") for f in features])

    def of_tree(t: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            f = t["feature"][node]
            right = (F.col("_x")[f] > t["threshold"][node]).cast("int")
            return F.when(f >= 0, 2 * node + right).otherwise(node)

        depth = F.floor(F.log2(F.size(t["feature"]).cast("double"))).cast("int")
        return t["rate"] * t["value"][F.aggregate(F.sequence(F.lit(1), depth), F.lit(1), down)]

    whole = F.aggregate("trees", F.lit(0.0), lambda a, t: a + of_tree(t))
    joined = df.withColumn("_x", x).join(models, key)
    return joined.withColumn("prediction", F.when(~F.exists("_x", F.isnull), whole)).drop("_x", "trees")


def importances(models: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, feature, weight): gains times rows of the splits on each feature, as shares of their sum."""
    names = F.array(*[F.lit(f) for f in features])
    each = models.select(key, F.explode("trees").alias("t"))
    each = each.select(key, F.explode(F.arrays_zip(F.col("t.feature").alias("f"), F.col("t.weight").alias("w"))).alias("x"))
    sums = each.filter("x.f >= 0").groupBy(key, F.col("x.f").alias("f")).agg(F.sum("x.w").alias("w"))
    totals = sums.groupBy(key).agg(F.sum("w").alias("total"))
    every = models.select(key, F.posexplode(names).alias("f", "feature"))
    share = F.coalesce(F.col("w") / F.col("total"), F.lit(0.0)).alias("weight")
    return every.join(sums, [key, "f"], "left").join(totals, key, "left").select(key, "feature", share)
