"""Hard negatives: rows of another label that score close to, but below, an anchor's positives.

Rows are sorted along distances to a bounded list of pivots and cut into parts of at most PART
rows. A task builds a cover tree of each of its parts: a norm coordinate is added to all rows, so
that an inner product falls with the distance, rows are put in by decreasing distance to those put
in before, and each level's covering radius bounds the products of everything below it. Anchors
are streamed past the trees. For each anchor nodes are opened best bound first; nodes outside all
windows, below the rank that is asked, or with only wrong labels are skipped; rows are compared by
their exact whole products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import keep

#: Rows of one tree; its distances take 8 * PART**2 bytes while it is built.
PART = 2048
#: Rows whose distances order the others; a list of at most this length goes to every task.
PIVOTS = 256
#: Slices that anchors are sent to, if there are so many trees, and trees of a slice beyond that.
SLICES, TREES = 256, 64
#: Covering radii of neighbouring levels.
STEP = 1.5
#: Nodes opened at a time.
OPEN = 128
FAR = 1 << 62
ROW = "vec_id bigint, label int, v array<bigint>"


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with noisy labels and whole components."""
    own = rows.select(*[F.col(f"`{c}`") for c in ("vec_id", "label", "embedding")])
    wide = F.col("embedding").cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    whole = F.transform(wide, lambda x: F.floor(256 * x).cast("bigint"))
    used = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    named = used.select("vec_id", F.struct(noisy.alias("label"), whole.alias("v")).alias("x"))
    return named.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("x").alias("x")).select("vec_id", "x.*")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows of exact numbers; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    borders = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(borders)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(borders[:-1] - borders[0], sizes)] = values[borders[0] : borders[-1]]
    # doubles hold all products of usual vectors exactly and multiply faster
    if float(np.abs(out).max(initial=0)) ** 2 * out.shape[1] < 2.0**52:
        return out.astype(np.float64)
    return out


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products with the common components."""
    d = min(rows.shape[1], q.shape[-1])
    if rows.dtype != q.dtype:
        rows, q = rows.astype(np.int64), q.astype(np.int64)
    return rows[:, :d] @ q[..., :d].T


def dealt(rows: DataFrame) -> DataFrame:
    """The rows with ``part``, parts holding at most PART neighbouring rows."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").toArrow()
    pivots = matrix(chosen.column("v")) if chosen.num_rows else np.zeros((1, 1))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v")).astype(np.float64)
            own = products(pivots.astype(np.float64), x)  # pivots by rows
            square = (x**2).sum(axis=1) - 2 * own + (pivots.astype(np.float64) ** 2).sum(axis=1)[:, None]
            cell = square.argmin(axis=0)
            place = square[cell, np.arange(len(cell))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(place)], [*batch.schema.names, "cell", "place"]
            )

    found = rows.mapInArrow(near, f"{ROW}, cell int, place double")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "place", "vec_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            part = (np.arange(seen, seen + len(batch)) // PART) * parts + own
            seen += len(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(part.astype(np.int64))], ["vec_id", "label", "v", "part"]
            )

    sorted_rows = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(cut, f"{ROW}, part bigint")


class CoverTree:
    """Rows by levels of halving distances; ``group``: the children of one row at one level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        # products and norms of the tree's shape may be rounded, the radii carry a margin for that
        wide = x.astype(np.float64)
        norms = (wide**2).sum(axis=1)
        top = norms.max()
        extra = np.sqrt(top - norms)
        far = np.sqrt(np.maximum(2 * (top - wide @ wide.T - np.outer(extra, extra)), 0))
        margin = 1e-6 * (1 + np.sqrt(top))
        order, reach = [0], [np.inf]
        least = far[0].copy()
        left = np.ones(len(ids), bool)
        left[0] = False
        while left.any():
            at = int(np.argmax(np.where(left, least, -1)))
            if least[at] <= margin:
                rest = np.flatnonzero(left)
                order += rest.tolist()
                reach += [0.0] * len(rest)
                break
            order.append(at)
            reach.append(least[at])
            left[at] = False
            np.minimum(least, far[at], out=least)
        self.order = np.array(order)
        self.ids, self.labels, self.x = ids[self.order], labels[self.order], x[self.order]
        far = far[np.ix_(self.order, self.order)]
        reach = np.array(reach)
        level = np.zeros(len(order), np.int64)
        if len(order) > 1:
            some = reach[1:] > 0
            level[1:][some] = 1 + np.floor(np.log(reach[1] / reach[1:][some]) / np.log(STEP) + 1e-9).astype(np.int64)
            level[1:][~some] = level.max() + 1
        # reach falls along the order, so the rows of upper levels come first
        parent = np.zeros(len(order), np.int64)
        for lev in np.unique(level[1:]):
            own = np.flatnonzero(level == lev)
            own = own[own > 0]
            parent[own] = far[own, : own[0]].argmin(axis=1)
        by = np.lexsort((level[1:], parent[1:])) + 1
        key = parent[by] * (level.max() + 1) + level[by]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(by) else np.zeros(0, np.int64)
        self.child = by
        self.start, self.end = start, np.append(start[1:], len(by)).astype(np.int64)
        self.parent = parent[by][start] if len(by) else start
        self.more = np.append(self.parent[1:] == self.parent[:-1], False) if len(start) else np.zeros(0, bool)
        group = np.full(len(order), -1)
        group[by] = np.repeat(np.arange(len(start)), self.end - self.start)
        self.radius = np.zeros(len(start))
        self.low, self.high = np.full(len(start), np.iinfo(np.int64).max), np.full(len(start), np.iinfo(np.int64).min)
        cur = np.arange(len(order))
        row = cur[group[cur] >= 0]
        while len(row):
            g = group[cur[row]]
            np.maximum.at(self.radius, g, far[self.parent[g], row])
            np.minimum.at(self.low, g, self.labels[row])
            np.maximum.at(self.high, g, self.labels[row])
            cur[row] = self.parent[g]
            row = row[group[cur[row]] >= 0]
        for g in range(len(start) - 2, -1, -1):
            if self.more[g]:
                self.radius[g] = max(self.radius[g], self.radius[g + 1])
                self.low[g], self.high[g] = min(self.low[g], self.low[g + 1]), max(self.high[g], self.high[g + 1])
        self.radius += margin
        self.first = np.full(len(order), -1)
        if len(start):
            heads = np.flatnonzero(np.append(True, self.parent[1:] != self.parent[:-1]))
            self.first[self.parent[heads]] = heads

    def search(self, best: Best) -> None:
        """Offer ``best`` all rows it can need, nodes with the greatest bounds first."""
        q = best.q
        best.offer(self.ids[:1], self.labels[:1], products(self.x[:1], q))
        group, score = self.first[:1], products(self.x[:1], q)
        group, score = group[group >= 0], score[group >= 0]
        while len(group):
            slack = best.norm * self.radius[group] * (1 + 1e-9)
            bound = score + slack
            wanted = best.wants(score - slack, bound) & best.can_hold(self.low[group], self.high[group])
            group, score, bound = group[wanted], score[wanted], bound[wanted]
            if len(group) > OPEN:
                cut = np.argpartition(-bound, OPEN)
                now, later = cut[:OPEN], cut[OPEN:]
            else:
                now, later = np.arange(len(group)), np.zeros(0, np.int64)
            opened = group[now]
            sizes = self.end[opened] - self.start[opened]
            places = np.arange(sizes.sum()) + np.repeat(self.start[opened] - np.cumsum(sizes) + sizes, sizes)
            rows = self.child[places]
            own = products(self.x[rows], q)
            best.offer(self.ids[rows], self.labels[rows], own)
            below, next_ = self.first[rows], self.more[opened]
            group = np.concatenate([group[later], below[below >= 0], opened[next_] + 1])
            score = np.concatenate([score[later], own[below >= 0], score[now][next_]])


class Best:
    """The first ``k`` rows of each window of one anchor among those offered so far."""

    def __init__(self, own: int, label: int, q: np.ndarray, same: bool, windows: list[tuple[int, int]], k: int):
        self.own, self.label, self.q, self.same, self.k = own, label, q, same, k
        self.norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        self.low = np.array([a for a, _ in windows], np.int64)
        self.high = np.array([b for _, b in windows], np.int64)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]

    def wants(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether rows that score between the bounds can still be needed."""
        return ((high[:, None] >= self.low) & (low[:, None] <= self.high)).any(axis=1)

    def can_hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether labels between these bounds can be right ones."""
        if self.same:
            return (low <= self.label) & (high >= self.label)
        return (low != self.label) | (high != self.label)

    def offer(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        right = ((labels == self.label) == self.same) & (ids != self.own)
        if not right.any():
            return
        ids, scores = ids[right], scores[right].astype(np.int64)
        for w, (known, points) in enumerate(self.found):
            fits = (scores >= self.low[w]) & (scores <= self.high[w])
            if not fits.any():
                continue
            known, points = np.concatenate([known, ids[fits]]), np.concatenate([points, scores[fits]])
            first = np.lexsort((known, -points))[: self.k]
            self.found[w] = known, points = known[first], points[first]
            if len(first) == self.k:  # ties go to smaller ids, so an equal score is still of use
                self.low[w] = max(self.low[w], points[-1])


def searched(trees: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(vec_id, window, id, score): for each anchor and window the first ``k`` rows of each slice.

    ``trees``: rows with ``part``; ``anchors``: rows with ``windows``, arrays of (low, high).
    Both are sent to slices, every anchor to all of them. In a slice the trees come first and are
    held; the anchors stream past. A tree's task needs memory for TREES parts and one batch.
    """
    # parts are numbered without large gaps
    number = (trees.agg(F.max("part")).first()[0] or 0) + 1
    slices = max(-(-number // TREES), min(number, SLICES))
    none = F.lit(None).cast("array<struct<low: bigint, high: bigint>>")
    left = trees.select((F.col("part") % slices).alias("slice"), "part", "vec_id", "label", "v", none.alias("windows"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))
    right = anchors.select(every.alias("slice"), F.lit(FAR).alias("part"), "vec_id", "label", "v", "windows")
    both = left.unionByName(right).repartition(slices, "slice").sortWithinPartitions("slice", "part", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, forest, parts = -1, [], []

        def grow() -> None:
            if parts:
                rows = pa.Table.from_batches(parts).combine_chunks()
                ids, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
                forest.append(CoverTree(ids, labels, matrix(rows.column("v"))))
                parts.clear()

        for batch in batches:
            slice_, part = (batch.column(c).to_numpy() for c in ("slice", "part"))
            new = np.flatnonzero((slice_[1:] != slice_[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(batch)], strict=True):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if slice_[a] != here:
                    grow()
                    here, forest = slice_[a], []
                if part[a] == FAR:
                    grow()
                    yield from answers(own, forest)
                    continue
                if parts and parts[-1].column("part")[0].as_py() != part[a]:
                    grow()
                parts.append(own)

    def answers(rows: pa.RecordBatch, forest: list[CoverTree]) -> Iterator[pa.RecordBatch]:
        ids, labels, windows = (rows.column(c).to_pylist() for c in ("vec_id", "label", "windows"))
        q = matrix(rows.column("v"))
        roots = np.stack([products(t.x[:1], q)[0] for t in forest]) if forest else np.zeros((0, len(ids)))
        out = [[], [], [], []]
        for i, anchor in enumerate(ids):
            best = Best(anchor, labels[i], q[i], same, [(w["low"], w["high"]) for w in windows[i]], k)
            for t in np.argsort(-roots[:, i]):
                forest[t].search(best)
            for w, (known, points) in enumerate(best.found):
                for x, y in zip(out, ([anchor] * len(known), [w] * len(known), known, points), strict=True):
                    x.extend(y)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["vec_id", "window", "id", "score"]
        )

    found = both.mapInArrow(run, "vec_id bigint, window int, id bigint, score bigint")
    order = Window.partitionBy("vec_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def window(low: Column, high: Column) -> Column:
    return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def mine(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; each has its first ``positives``
    other rows of the same label, and for each of those the first ``negatives`` rows of other
    labels that score ``low`` to ``high`` percent of it. Scores are inner products of whole
    components floor(256 * x); higher come first, ties by the smaller vec_id.

    Rows without vec_id, label or vector or with a null or non-finite component take no part. Of
    rows with equal vec_id the one with the smallest label, then vector, does. Vectors of different
    lengths are compared as if the shorter ended in zeros. A positive without negatives, an anchor
    without positives and an empty table give no rows. Columns other than vec_id, label and
    embedding are ignored. Products must fit 63 bits.
    """
    trees = keep(dealt(keep(prepared(rows), "vectors")), "vectors-dealt")
    anchors = trees.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "v")
    whole = anchors.withColumn("windows", F.array(window(F.lit(-FAR), F.lit(FAR))))
    near = keep(searched(trees, whole, True, positives).drop("window"), "positives")
    percent = lambda n, up: F.call_function("div", F.col("score") * n + (99 if up else 0), F.lit(100))
    # a positive that scores less than zero has no window, one of zero has zero alone
    rank = F.col("rank").alias("rank")
    spans = near.filter("score >= 0").select(
        "vec_id", F.struct(rank, "id", "score", window(percent(low, True), percent(high, False)).alias("w")).alias("x")
    )
    spans = spans.groupBy("vec_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    asked = keep(anchors.join(spans, "vec_id"), "windows")
    found = searched(trees, asked.withColumn("windows", F.transform("x", lambda x: x["w"])).drop("x"), False, negatives)
    met = asked.select("vec_id", F.posexplode("x").alias("window", "x")).join(found, ["vec_id", "window"])
    return met.select(
        F.col("vec_id").alias("anchor_id"),
        F.col("x.id").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("x.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
