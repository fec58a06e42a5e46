"""Frames under names that SQL text can use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def register(**frames: DataFrame) -> list[str]:
    """Make each frame a temporary view of its session under its name, replacing an older one.

    Nothing is read or written; the names last as long as the session. Names are plain identifiers.
    """
    for name in frames:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"{name!r} is no name for a view")
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return sorted(frames)
