"""Windows over long ordered series without one task per series.

A series is cut into chunks of neighbouring positions. Each row is sent to its
own chunk and, when it lies within reach of a chunk border, to the neighbour as
context. A window over (series, chunk) then sees all the rows it needs, and only
home rows are kept. Running sums add the totals of the earlier chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CHUNK = 4096
MONTH_SECONDS = 30 * 86_400


def spread(df: DataFrame, pos: str, before: int, after: int = 0, chunk: int | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_home``; rows near a border appear in two chunks."""
    size = max(chunk or CHUNK, before, after, 1)
    p = F.col(pos)
    own = F.floor(p / size)
    where = F.array_distinct(F.array(own, F.floor((p + before) / size), F.floor((p - after) / size)))
    return df.withColumn("_chunk", F.explode(where)).withColumn("_home", F.col("_chunk") == own)


def window(keys: list[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def home(df: DataFrame) -> DataFrame:
    """Keep each row once, in its own chunk."""
    return df.filter("_home").drop("_home", "_chunk")


def index_rows(df: DataFrame, keys: list[str], ts: str, seconds: int = MONTH_SECONDS, name: str = "pos") -> DataFrame:
    """0-based row number per key in time order, counted bucket by bucket."""
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
    marked = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    numbered = marked.join(base, [*keys, "_bucket"])
    place = (F.col("_base") + F.row_number().over(inside) - 1).cast("int")
    return numbered.withColumn(name, place).drop("_bucket", "_base")


def running_sums(df: DataFrame, keys: list[str], pos: str, cells: dict[str, Column], chunk: int | None = None) -> DataFrame:
    """Sums of the cells over all earlier rows of the key (the row itself is left out)."""
    own = df.withColumns({f"_x_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in cells.items()})
    own = own.withColumn("_chunk", F.floor(F.col(pos) / (chunk or CHUNK)))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "_chunk").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in cells])
    base = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)).alias(f"_b_{n}") for n in cells]
    )
    inside = window(keys, pos).rowsBetween(Window.unboundedPreceding, -1)
    joined = own.join(base, [*keys, "_chunk"])
    out = joined.withColumns(
        {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_x_{n}").over(inside), F.lit(0.0)) for n in cells}
    )
    return out.drop("_chunk", *[f"_x_{n}" for n in cells], *[f"_b_{n}" for n in cells])
