"""Principal components of wide sparse vectors, without the square matrix of all dimensions.

Only products of the rows with a narrow block of vectors are needed. A pass multiplies every row
with the block and back, tasks add up what they get, and the sums, as long as a vector and as wide
as the block, come to the driver. The blocks of all passes span the space in which the greatest
components are sought, until they no longer change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a block, passes at most, and the residual of a component (against the greatest) that ends them.
WIDTH, PASSES, CLOSE = 8, 60, 1e-11
#: Entries of one added-up part of a sum.
PART = 1 << 16


def sparse(vector: Column) -> Column:
    """(size, indices, values) of a vector column; indices are null for a dense one."""
    raw = F.unwrap_udt(vector)
    return F.struct(
        F.coalesce(raw["size"], F.size(raw["values"])).alias("size"), raw["indices"].alias("indices"), raw["values"].alias("values")
    )


class Rows:
    """The rows of a batch: entries side by side, and their dimension."""

    def __init__(self, cells: pd.DataFrame):
        values = [np.asarray(v, float) for v in cells["values"]]
        indices = [np.arange(len(v)) if i is None else np.asarray(i) for i, v in zip(cells["indices"], values, strict=True)]
        sizes = [len(v) for v in values]
        self.count = len(values)
        self.row = np.repeat(np.arange(len(values)), sizes)
        self.index = np.concatenate(indices).astype(np.int64) if values else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0)

    def times(self, block: np.ndarray) -> np.ndarray:
        out = np.empty((self.count, block.shape[1]))
        for j in range(block.shape[1]):
            out[:, j] = np.bincount(self.row, self.value * block[self.index, j], self.count)
        return out

    def back(self, block: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((size, block.shape[1]))
        for j in range(block.shape[1]):
            out[:, j] = np.bincount(self.index, self.value * block[self.row, j], size)
        return out


def added_up(cells: DataFrame, of_rows: Callable[[Rows], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix of the given shape, added up in the tasks and then part by part."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            total += of_rows(Rows(batch))
        flat = total.ravel()
        for at in range(0, len(flat), PART):
            yield pd.DataFrame({"part": [at // PART], "sums": [flat[at : at + PART].tobytes()]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(sums=[np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0).tobytes()])

    kind = "part int, sums binary"
    found = cells.mapInPandas(partial, kind).groupBy("part").applyInPandas(joined, kind).collect()
    out = np.zeros(shape).ravel()
    for r in found:
        sums = np.frombuffer(r["sums"])
        out[r["part"] * PART : r["part"] * PART + len(sums)] = sums
    return out.reshape(shape)


def principal(cells: DataFrame, k: int, scale: bool, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components (dimensions by ``k``), their shares of the variance, and the factor of each dimension."""
    size = cells.agg(F.max("size")).first()[0] or 0
    if not size:
        return np.zeros((0, k)), np.zeros(k), np.zeros(0)
    one = np.ones

    def moments(rows: Rows) -> np.ndarray:
        out = rows.back(one((rows.count, 1)), size)
        squares = np.bincount(rows.index, rows.value**2, size)
        return np.column_stack([out[:, 0], squares, np.full(size, float(rows.count))])

    sums = added_up(cells, moments, (size, 3))
    n = sums[0, 2]
    mean = sums[:, 0] / n
    variance = np.maximum(sums[:, 1] - n * mean**2, 0) / max(n - 1, 1)
    # what is left of a constant dimension after cancellation is no variance
    variance[variance <= 1e-14 * sums[:, 1] / n] = 0
    factor = np.where(variance > 0, 1 / np.sqrt(np.where(variance > 0, variance, 1)), 0) if scale else one(size)
    total = (variance * factor**2).sum()
    centre = mean * factor

    def covariance(block: np.ndarray) -> np.ndarray:
        thick = factor[:, None] * block
        product = added_up(cells, lambda rows: rows.back(rows.times(thick), size), block.shape)
        return (factor[:, None] * product - n * np.outer(centre, centre @ block)) / max(n - 1, 1)

    width = min(WIDTH + k, size)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    top, values = np.zeros((size, k)), np.zeros(k)
    for _ in range(PASSES):
        image = covariance(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        spread, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-spread)[:k]
        values, top = spread[order], basis @ turn[:, order]
        residual = np.linalg.norm(images @ turn[:, order] - top * values, axis=0).max()
        if residual <= CLOSE * max(abs(values[0]), 1e-300) or basis.shape[1] >= size:
            break
        # the next block is what the last one added, free of all before
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        length = np.linalg.norm(image, axis=0)
        image = image[:, length > 1e-13 * max(abs(values[0]), 1e-300)]
        if not image.shape[1]:
            break
        block = np.linalg.qr(image)[0][:, : size - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    out, shares = np.zeros((size, k)), np.zeros(k)
    out[:, : top.shape[1]] = top * np.where(top[np.abs(top).argmax(axis=0), range(top.shape[1])] < 0, -1, 1)
    shares[: len(values)] = values / total if total > 0 else 0
    return out, shares, factor


def components(df: DataFrame, vector: str, k: int = 2, scale: bool = True) -> tuple[DataFrame, list[float]]:
    """Add pc1 .. pck; returns the frame and the explained variance shares.

    With ``scale`` each dimension is divided by its deviation first, without
    centring, and the components are taken of the scaled column. The entry of
    largest size of a component is positive. A null vector has null places.
    """
    held = F.col(vector) if isinstance(df.schema[vector].dataType, VectorUDT) else array_to_vector(F.col(vector))
    own = df.withColumn("_cells", F.when(F.col(vector).isNotNull(), sparse(held)))
    axes, shares, factor = principal(own.filter(F.col(vector).isNotNull()).select("_cells.*"), k, scale)
    sent = df.sparkSession.sparkContext.broadcast(factor[:, None] * axes)

    @F.pandas_udf("array<double>")
    def places(cells: pd.DataFrame) -> pd.Series:
        known = cells["values"].notna()
        found = iter(Rows(cells[known]).times(sent.value).tolist())
        return pd.Series([next(found) if x else None for x in known])

    placed = own.withColumn("_pc", places("_cells"))
    return placed.select(*df.columns, *[F.get("_pc", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)]), shares.tolist()
