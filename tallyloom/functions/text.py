"""Text, tag and markup columns, all built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Handles, links and every sign that is no ASCII letter, digit, blank or tab.
NOISE = r"(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/\S+)"

WORD_BREAK = r"\W+"
LETTER_BREAK = r"[^\p{L}]+"


def clean_text(text: Column) -> Column:
    """Drop handles, links and signs, then squeeze blanks."""
    bare = F.regexp_replace(text, NOISE, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def tokens(text: Column, min_length: int = 2, pattern: str = WORD_BREAK) -> Column:
    """Lower-case words of at least ``min_length`` signs."""
    return F.filter(F.split(F.lower(text), pattern), lambda w: F.length(w) >= min_length)


def word_grams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words joined by a blank; empty when the text is shorter."""
    if n == 1:
        return words
    # shifted copies side by side: one pass over the words, whatever their expression costs
    length = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, i + 1, length).alias(f"w{i}") for i in range(n)])
    return F.transform(shifted, lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(n)]))


def char_grams(words: Column, n: int = 3) -> Column:
    """Letter runs inside each word; a shorter word stands for itself."""
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(w) - F.lit(n - 1), F.lit(1))),
                lambda i: F.substring(w, i, F.lit(n)),
            ),
        )
    )


def parse_tags(cell: Column, strip: bool = True) -> Column:
    """List literal ``['#a', '#b']`` to an array.

    ``[]`` gives one empty string. Without ``strip`` the elements keep their
    quotes and leading blanks.
    """
    inner = F.substring_index(F.substring_index(cell, "]", 1), "[", -1)
    if strip:
        inner = F.regexp_replace(inner, "[' ]", "")
    return F.split(inner, ",")


def tag_literal(tags: Column) -> Column:
    """The inverse of :func:`parse_tags`, used by the CSV writer."""
    return F.when(F.size(tags) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(tags, "', '"), F.lit("']"))
    )


def real_tags(tags: Column) -> Column:
    """The array without blank elements."""
    return F.filter(tags, lambda t: F.length(t) > 0)


def lower_distinct(words: Column) -> Column:
    """Lower-case elements, each once, in sorted order."""
    return F.array_sort(F.array_distinct(F.transform(words, F.lower)))


def strip_tags(markup: Column) -> Column:
    """Text of a markup fragment with blanks squeezed."""
    from tallyloom.functions.markup import without_comments, without_tags

    return F.trim(F.regexp_replace(without_tags(without_comments(markup), " "), r"\s++", " "))


def text_content(markup: Column) -> Column:
    """Text of inline markup as a reader sees it: tags and comments vanish, common entities are decoded."""
    from tallyloom.functions.markup import without_comments, without_tags

    return decoded(without_tags(without_comments(markup)))


def decoded(out: Column) -> Column:
    """Common entities as signs."""
    # Entities; the ampersand comes last so that nothing is decoded twice.
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def drop_anchors(markup: Column, greedy: bool = False) -> Column:
    """Remove anchor elements with their text.

    Each anchor ends at its own close tag; one that is never closed stays. The greedy form removes
    everything from the first anchor to the last close tag.
    """
    from tallyloom.functions.markup import REST

    return F.regexp_replace(markup, r"(?s)<a\s.*</a>" if greedy else rf"(?s)<a\s{REST}>.*?</a\s*+>", "")


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised words that do not open a sentence.

    The word before the run ends in a lower-case letter or a comma, so the
    first word after a full stop is never taken.
    """
    return F.regexp_extract_all(text, F.lit(r"[a-z,] ([A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)*)"), 1)
