"""CSV in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import parse_tags, real_tags, tag_literal
from tallyloom.functions.timeparts import POST_FORMAT, count_or_zero, leading_hour, post_timestamp
from tallyloom.storage import written

# The columns of the posts file and of the prepared parking file, in file order.
POST_COLUMNS = ["id", "creator", "hashtags", "timestamp", "reshares", "likes", "num_replies", "text", "clean_text"]
PARKING_COLUMNS = ["name", "free", "weekday", "month", "day", "year", "hour"]

# A quote inside a cell is doubled, and an empty cell is told from a missing one.
DIALECT = {"quote": "\"", "escape": "\"", "nullValue": "\\N"}


def write_csv(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Headered CSV in files of bounded length."""
    df.write.options(header=True, maxRecordsPerFile=rows_per_file, **DIALECT).csv(path)


PIECE = "file string, block bigint, kind int, first boolean, record string"
#: What a piece of a record is: whole, the end or a middle of one begun in an earlier block, the begin of one.
WHOLE, END, MIDDLE, BEGIN = 0, 1, 2, 3


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of CSV files, whose quoted cells may hold line ends.

    A file is read in blocks by many tasks. Whether a block begins inside a quoted cell follows from
    the quotes of all blocks before it, of which only the parity counts; records that cross blocks
    are put together from their pieces. ``first`` marks the first record of a file. Quotes must
    come in pairs, as in the dialect here; empty records are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a flag for each block, a list no longer than the one Spark plans the scan with
    begun = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("open"))
    open_blocks = {(r["file"], r["block"]) for r in begun.filter("open = 1").collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside, first, held, entered = None, False, False, [], False
        out: list[tuple] = []

        def close(left: tuple) -> None:
            if held:
                out.append((*left, MIDDLE if entered else BEGIN, first, "\n".join(held)))

        for batch in batches:
            cells = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for file, block, value in cells:
                if (file, block) != place:
                    close(place)
                    place, held, first = (file, block), [], block == 0
                    inside = entered = place in open_blocks
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    out.append((file, block, END if entered else WHOLE, first, "\n".join(held)))
                    held, first, entered = [], False, False
            yield pieces(out)
            out = []
        close(place)
        yield pieces(out)

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        cells = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(cells, ["file", "block", "kind", "first", "record"])

    cut_up = written(lines.mapInArrow(cut, PIECE), "records")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # one or two pieces of each block; a record's own begin the same run
    torn = cut_up.filter(F.col("kind") != WHOLE).withColumn("run", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    part = F.struct("block", "kind", "record")
    whole = torn.groupBy("file", "run").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["record"]), "\n")
    every = cut_up.filter(F.col("kind") == WHOLE).select("file", "first", "record")
    every = every.unionByName(whole.select("file", "first", text.alias("record")))
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered CSV with quoted line ends and declared types: no second pass to infer them.

    Names come from the schema and cells are cleared of the carriage return of their line end.
    Any number of tasks read a file, see ``records``.
    """
    rows = records(spark, path).filter("NOT first")
    # cells hold line ends as they are
    return rows.select(F.from_csv("record", schema, {"multiLine": "true", **DIALECT}).alias("x")).select("x.*")


def read_positional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headerless CSV; columns are named by position and read as text."""
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path)


def write_posts(posts: DataFrame, path: str) -> None:
    """Typed posts to the posts file: tags as a list literal, time as post text."""
    out = posts.select(
        "id",
        "creator",
        tag_literal(F.col("hashtags")).alias("hashtags"),
        F.date_format("ts", POST_FORMAT).alias("timestamp"),
        "reshares",
        "likes",
        "num_replies",
        "text",
        "clean_text",
    )
    write_csv(out, path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """The posts file as typed posts; unreadable times become null, empty counters 0."""
    raw = read_csv(spark, path, ", ".join(f"{c} string" for c in POST_COLUMNS))
    return raw.select(
        "id",
        "creator",
        real_tags(parse_tags(F.col("hashtags"))).alias("hashtags"),
        post_timestamp(F.col("timestamp")).alias("ts"),
        *[count_or_zero(F.col(c)).alias(c) for c in ("reshares", "likes", "num_replies")],
        "text",
        "clean_text",
    )


def read_parking(spark: SparkSession, path: str) -> DataFrame:
    """Prepared parking rows with typed code, free places and hour."""
    raw = read_positional(spark, path, PARKING_COLUMNS)
    return raw.select(
        F.col("name").try_cast("int").alias("code"),
        F.col("free").try_cast("int").alias("free"),
        "weekday",
        *[F.col(c).try_cast("int").alias(c) for c in ("year", "month", "day")],
        leading_hour(F.col("hour")).alias("hour"),
    )


def flat_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row as one line of text, cells joined by a blank, missing cells as empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (columns or df.columns)]
    return df.select(F.concat_ws(" ", *cells).alias("line"))
