"""Names in texts: capitalised runs, optionally checked against a list of known names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import capitalised_runs
from tallyloom.storage import small_side


def entities(df: DataFrame, text: str, *keys: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """(keys, entity), one row per mention; a null or empty text has none."""
    found = df.select(*keys, F.explode(capitalised_runs(F.col(text))).alias("entity"))
    if gazetteer is None:
        return found
    return found.join(small_side(gazetteer.select("entity").distinct()), "entity", "left_semi")


def entity_counts(df: DataFrame, text: str, *keys: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """Mentions of each entity per key."""
    found = entities(df, text, *keys, gazetteer=gazetteer)
    return found.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("n"))
