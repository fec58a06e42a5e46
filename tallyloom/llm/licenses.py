"""License texts and phrases by diagonal voting.

Every run of GRAM words of every text is joined by its hash to the places of the same run in the
templates. A match votes for its diagonal: place in the text minus place in the template. Diagonals
next to each other (a word more or less) are merged into one island, and an island is reported if it
covers enough of its template within a span that is not much longer, the telling words of the template
among it, unbroken. Short phrases must be whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Words, chunks, plain

GRAM = 3
#: Bytes that separate words: ASCII other than letters and digits.
BREAKS = frozenset(b for b in range(0x80) if not chr(b).isalnum())
# The phrases of the base and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Passages of public licenses; a text that holds most of one gets the label.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
    ("licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "cc-by-nc-sa"),
    ("licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "cc-by-nc-nd"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu lesser general public license version 2 1", "lgpl-2-1"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words that tell a license from its kin, by label: every run of them must agree, so that no other version
#: number and no word more or less among them passes. Labels that are not listed need their share only.
TELLING = {
    "mit": ("deal in the",),
    "isc": ("with or without fee",),
    "gpl": ("the gnu general public license",),
    "lgpl": ("the gnu lesser general public license",),
    "agpl": ("the gnu affero general public license",),
    "gpl-2": ("the gnu general public license version 2",),
    "gpl-3": ("the gnu general public license version 3",),
    "lgpl-2-1": ("the gnu lesser general public license version 2 1",),
    "lgpl-3": ("the gnu lesser general public license version 3",),
    "agpl-3": ("the gnu affero general public license version 3",),
    "mpl": ("the mozilla public license",),
    "unlicense": ("into the public domain",),
    "cc-by": ("commons attribution 4 0 international",),
    "cc-by-sa": ("commons attribution sharealike 4 0 international",),
    "cc-by-nd": ("commons attribution noderivatives 4 0 international",),
    "cc-by-nc": ("commons attribution noncommercial 4 0 international",),
    "cc-by-nc-sa": ("commons attribution noncommercial sharealike 4 0 international",),
    "cc-by-nc-nd": ("commons attribution noncommercial noderivatives 4 0 international",),
}
#: Diagonals this near are merged; least share of a template's runs; longest span as a share of the template.
NEIGHBOUR, COVER, STRETCH = 3, 0.75, 1.5
ROWS = "row bigint, doc_id bigint, n_words bigint, at bigint, h bigint"


def template_table(
    templates: Sequence[tuple[str, str]] = TEMPLATES, telling: Mapping[str, Sequence[str]] = TELLING
) -> list[tuple[int, int, int, str, int, bool, bool, int]]:
    """h, template, place, label, number of runs, whether it is a phrase of the base, whether the run
    is one of the telling words, and how many such runs the template has."""
    runs_of = lambda text: Words(pa.array([text]), BREAKS).grams(GRAM)
    out = []
    for i, (text, label) in enumerate((*PHRASES, *templates)):
        grams, at = runs_of(text)
        base = i < len(PHRASES)
        told = {int(g) for phrase in (() if base else telling.get(label, ())) for g in runs_of(phrase)[0]}
        needed = [int(g) in told for g in grams]
        out += [
            (int(g), i, int(p), label, len(at), base, n, sum(needed))
            for g, p, n in zip(grams.view(np.int64), at, needed, strict=True)
        ]
    return out


def runs(docs: DataFrame) -> DataFrame:
    """All word runs of all rows: row (a number of its own), at, h; and one line per row with at = -1
    that carries doc_id and n_words. Null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column(1), BREAKS)
                n = part.num_rows
                grams, at = words.grams(GRAM)
                whose = words.row[at]
                place = at - words.first[whose]
                mine = np.arange(row, row + n)
                row += n
                none, more = pa.nulls(len(at), pa.int64()), np.diff(words.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mine, mine[whose]])),
                        pa.concat_arrays([part.column(0), none]),
                        pa.concat_arrays([pa.array(more.astype(np.int64)), none]),
                        pa.array(np.concatenate([np.full(n, -1), place])),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(grams.view(np.int64))]),
                    ],
                    ["row", "doc_id", "n_words", "at", "h"],
                )

    return plain(docs, "doc_id", "text").mapInArrow(work, ROWS)


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, telling: Mapping[str, Sequence[str]] = TELLING
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    Base places are diagonals on which every run of a phrase agrees. ``spans`` has label, first word,
    end and the share of the template; score is the best share (0 where nothing matches). Repeated
    rows are reported each. ``templates`` are passages with their labels, of GRAM words or more, and
    ``telling`` the words by label that must agree whole (see TELLING). The list is small, so it is sent
    to all tasks; only matches leave them.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(
        template_table(templates, telling), "h bigint, template int, place int, label string, size int, base boolean, needed boolean, needs int"
    )
    met = runs(docs).join(F.broadcast(table), "h", "left").filter("at = -1 or template is not null")
    # all matches of a row go to one task: a few per text, however many texts share a passage
    votes = met.withColumn("diagonal", F.when(F.col("at") >= 0, F.col("at") - F.col("place"))).repartition("row")
    votes = votes.groupBy("row", "template", "diagonal").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("size").alias("size"),
        F.max("base").alias("base"), F.max("needs").alias("needs"), F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("needed"), F.col("place"))).alias("telling"), F.min("at").alias("first"), F.max("at").alias("last"),
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("base") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near), F.lit(NEIGHBOUR + 1)) > NEIGHBOUR)
    islands = votes.withColumn("island", F.sum(fresh.cast("int")).over(near)).groupBy("row", "template", "island").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("size").alias("size"), F.max("base").alias("base"),
        F.max("needs").alias("needs"), F.size(F.array_distinct(F.flatten(F.collect_list("telling")))).alias("met"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min("first").alias("first"), (F.max("last") + GRAM).alias("end"),
    )
    share = F.col("covered") / F.col("size")
    whole = F.col("base") & (F.col("covered") == F.col("size"))
    long_ = ~F.col("base") & (share >= COVER) & (F.col("met") == F.col("needs")) & (F.col("end") - F.col("first") <= (F.col("size") + GRAM - 1) * STRETCH)
    found = islands.withColumn("share", share).withColumn("whole", whole).withColumn("told", whole | long_)
    span = F.struct("first", "end", "label", "share")
    out = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("whole"), 1).otherwise(0)).cast("bigint").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("first"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("told"), F.col("label"))))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("told"), span))).alias("spans"),
    )
    return out.drop("row")
