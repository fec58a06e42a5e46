"""Patterns and columns over markup that heed quotes, comments and elements without an end.

A sign ``>`` ends a tag only outside quotes, and a quote counts only behind an equals sign, as in
attributes. Every loop eats a run it never gives back or a single sign, so patterns stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import decoded

#: The inside of a tag up to its end, and the same taken sign by sign up to what follows in a pattern.
REST = r"""(?:[^>=]++|=(?!\s*+["'])|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
GAP = r"""(?:[^>=]|=(?!\s*+["'])|=\s*+"[^"]*+"|=\s*+'[^']*+')*?"""
COMMENT = r"(?s)<!--.*?(?:-->|$)"
TAG = rf"</?[a-zA-Z]{REST}>|<[!?][^>]*+>"
#: Elements whose content is no text of the page.
RAW = rf"(?is)<(script|style)\b{REST}>.*?</\1\s*+>"
PAIR = r"""[^\s=>"'/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""


def without_comments(markup: Column) -> Column:
    return F.regexp_replace(markup, COMMENT, "")


def without_tags(markup: Column, between: str = "") -> Column:
    """Tags replaced; text that holds a lone ``<`` stays."""
    return F.regexp_replace(markup, TAG, between)


def open_tags(markup: Column, name: str) -> Column:
    """All begin tags of an element, as written."""
    return F.regexp_extract_all(markup, F.lit(rf"(?i)<{name}(?=[\s/>]){REST}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a begin tag, null without one. Pairs are read from left to right, so
    what looks like an attribute inside the value of another is none."""
    pairs = F.regexp_extract_all(tag, F.lit(PAIR), F.lit(0))
    own = F.get(F.filter(pairs, lambda p: F.lower(F.rtrim(F.substring_index(p, "=", 1))) == name), F.lit(0))
    value = F.ltrim(F.substring(own, F.instr(own, "=") + 1, F.length(own)))
    quoted = F.regexp_like(value, F.lit("^[\"']"))
    return decoded(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def content(markup: Column, opening: str, name: str = "div") -> Column:
    """What the first element that matches ``opening`` holds, elements of the same name inside it
    included; empty without one, and all that follows if it is never closed.

    The rest is cut before each begin and end tag of that name, and the pieces are counted until the
    element is closed. Other elements need no end for that.
    """
    rest = F.coalesce(F.get(F.split(markup, opening, 2), F.lit(1)), F.lit(""))
    pieces = F.split(rest, rf"(?i)(?=<{name}(?=[\s/>])|</{name}\s*+>)")
    begin_tag, end_tag = F.lit(rf"(?i)^<{name}(?=[\s/>])"), F.lit(rf"(?i)^</{name}\s*+>")

    def step(acc: Column, piece: Column) -> Column:
        turn = F.when(F.regexp_like(piece, begin_tag), 1).when(F.regexp_like(piece, end_tag), -1).otherwise(0)
        depth = F.when(acc["depth"] > 0, acc["depth"] + turn).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"))

    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    held = F.aggregate(pieces, begin, step, lambda acc: acc["n"])
    return F.array_join(F.slice(pieces, F.lit(1), held), "")
