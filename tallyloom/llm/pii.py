"""Personal data in texts: plain patterns as seeds, and lexical patterns that the seeds teach.

Only DataFrame functions. Each kind has a pattern and a test; what passes is a seed. Seeds, and other
stretches that look like identifiers, induce lexical patterns of several widths: the word, the two
words or the label before them, the words on both sides, and the shape of the value itself. Patterns
and values form a graph. A pattern scores by the share of its different values that are of a kind,
drawn towards the share of that kind among all values, so that a pattern with few values says little.
A value that is no seed scores by its patterns, and counts as a seed in the next round if one of them
is sure; shapes are taught by true seeds alone. After a fixed number of rounds sure patterns report the stretches in their place, unless the
kind's own pattern fits the stretch and its test refuses it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import keep, plain
from tallyloom.llm.spans import bound, ordered, sums_before

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# Runs are taken whole and never given back, so a long run of one class costs one pass; a match may
# begin inside a run only where the match before it ended.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: What may be an identifier: signs on both sides of an @, digits in groups by spaces, brackets or dashes, or
#: a token of six signs or more, one a digit. Whether it is one is left to its contexts.
PARTS = (rf"[{LOCAL}]++@[@{LOCAL}]++", r"[(+]*+[0-9]++(?:[ ()-]{1,3}+[0-9]++)++", rf"(?=[@._%+A-Za-z-]*+[0-9])[@{LOCAL}]{{6,}}+")
TOKEN = rf"(?:(?<![@{LOCAL}])|\G)(?:{'|'.join(PARTS)})"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
NEAR = 40
ROUNDS = 3
#: A pattern's score is drawn to the kind's overall share as if by so many more values; from SURE on it reports.
PRIOR, SURE = 8.0, 0.8
#: A stretch of digit groups is looked at as a whole and by all runs of so many groups.
GROUPS = 4
SPAN = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"


def places(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost matches that do not overlap: kind, start, end (code points), value, and the text
    beside them up to the next match. The text between matches gives their places."""
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def told(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["between"], 1, F.size(x["found"])), x["found"], lambda p, v: F.length(p) + F.length(v))
        return bound(sums_before(sizes), lambda before: F.transform(x["found"], lambda v, i: span(x["between"], v, i, before)))

    def span(between: Column, v: Column, i: Column, before: Column) -> Column:
        start = F.get(before, i) + F.length(F.get(between, i))
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"),
            F.right(F.get(between, i), F.lit(NEAR)).alias("left"), F.left(F.get(between, i + 1), F.lit(NEAR)).alias("right"),
        )

    return bound(both, told)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(x: Column) -> Column:
    """The test of each kind."""
    number = digits(x["value"])
    card = F.length(number).between(12, 19) & F.call_function("luhn_check", number)
    ip = F.regexp_like(x["value"], F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    return (
        F.when(x["kind"] == "ip", ip)
        .when(x["kind"] == "card", card)
        .when(x["kind"] == "phone", F.length(number).between(9, 15))
        .otherwise(F.lit(True))
    )


def seeds(text: Column) -> Column:
    """The base spans of a text, by start and kind; a pattern runs only where its sign occurs."""
    empty = F.array().cast(f"array<{SPAN}>")
    tried = [("email", EMAIL, F.contains(text, F.lit("@"))), ("ip", IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")))]
    tried += [("card", CARD, F.regexp_like(text, F.lit("[0-9][ -]?[0-9]"))), ("phone", PHONE, F.contains(text, F.lit("+")))]
    found = [F.when(sign, F.filter(places(text, pattern, kind), passes)).otherwise(empty) for kind, pattern, sign in tried]
    return F.concat(*found)


def pieces(x: Column) -> Column:
    """A stretch as a whole and all its runs of up to GROUPS groups between spaces, with their places.
    The words beside it are those of the whole; its runs are told by their shape alone."""
    words = F.split(x["value"], " ")

    def cut(own: Column) -> Column:
        sizes = F.transform(own, lambda w: F.length(w) + 1)
        return bound(F.struct(own.alias("own"), sums_before(sizes).alias("at")), runs)

    def runs(y: Column) -> Column:
        every = F.flatten(F.transform(y["own"], lambda _, i: F.transform(F.array(*[F.lit(k) for k in range(1, GROUPS + 1)]), lambda k: run(y, i, k))))
        return F.filter(every, lambda r: (F.length(r["value"]) >= 6) & (r["value"] != x["value"]))

    def run(y: Column, i: Column, k: Column) -> Column:
        # runs that would pass the end are empty and dropped by their length
        inside = i + k <= F.size(y["own"])
        value = F.when(inside, F.array_join(F.slice(y["own"], i + 1, k), " ")).otherwise(F.lit(""))
        start = x["start"] + F.get(y["at"], i)
        return F.struct(
            x["kind"].alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            F.lit("").alias("left"), F.lit("").alias("right"),
        )

    return F.when(F.contains(x["value"], F.lit(" ")), F.concat(F.array(x), bound(words, cut))).otherwise(F.array(x))


def others(text: Column, known: Column) -> Column:
    """Identifier-like stretches (TOKEN) and their parts, as far as they touch no base span."""
    empty = F.array().cast(f"array<{SPAN}>")
    free = lambda x: ~F.exists(known, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    looked = F.filter(F.flatten(F.transform(places(text, TOKEN, "other"), pieces)), free)
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), looked).otherwise(empty)


def shape(value: Column) -> Column:
    """The value with letters as a and digits as 9, runs of letters as one."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")


def contexts(x: Column) -> Column:
    """The lexical patterns of a span. Kinds of pattern are told apart by their first word."""
    before = F.regexp_extract_all(F.lower(x["left"]), F.lit(r"\p{L}+"), F.lit(0))
    after = F.regexp_extract(F.lower(x["right"]), r"^[^\p{L}]*(\p{L}+)", 1)
    label = F.regexp_extract(F.lower(x["left"]), r"(\p{L}+ ?[:=#(])[ \"']*$", 1)
    last = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))
    two = F.concat_ws(" ", F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("")), last)
    form = shape(x["value"])
    parts = {"one": last, "two": two, "both": F.concat_ws(" _ ", last, after), "label": label, "form": form, "class": F.regexp_replace(form, "9+", "9")}
    named = [F.concat(F.lit(f"{name} "), part) for name, part in parts.items()]
    return F.filter(F.array(*named), lambda p: ~p.isin("one ", "two  ", "both  _ ", "label "))


def read(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), known (base spans) and other (further tokens) of every row."""
    docs = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    both = bound(seeds(F.col("text")), lambda known: F.struct(known.alias("known"), others(F.col("text"), known).alias("other")))
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), both.alias("x")).select("doc_id", "tag", "x.known", "x.other")


def edges(rows: DataFrame) -> DataFrame:
    """The different (pattern, value, kind) that meet; ``other`` is the kind of what is no seed. Made
    distinct before the shuffle, so copies of a text and frequent values count once."""
    span = F.explode(F.concat("known", "other")).alias("x")
    met = rows.select(span).select("x.kind", F.xxhash64("x.value", "x.kind").alias("key"), F.explode(contexts(F.col("x"))).alias("pattern"))
    return met.distinct()


def pattern_scores(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, n (different values) and a score for each kind, after scoring both sides in turn."""
    graph = keep(graph, "pii-edges")
    values = keep(graph.select("key", "kind").distinct(), "pii-values")
    totals = values.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]).first()
    # where nearly all values are of one kind, that alone is no evidence
    shares = {k: min(totals[k] / max(totals["n"], 1), 0.5) for k in KINDS}
    values = values.select("key", *[(F.col("kind") == k).cast("double").alias(f"s_{k}") for k in KINDS])
    for turn in range(rounds):
        # shapes are wide patterns: only true seeds teach them, so that one found value does not bring in all of its shape
        told = lambda k: F.when(F.regexp_like("pattern", F.lit("^(form|class) ")), (F.col("kind") == k).cast("double")).otherwise(F.col(f"s_{k}"))
        drawn = lambda k: (F.sum(told(k)) + PRIOR * shares[k]) / (F.count(F.lit(1)) + PRIOR)
        scores = graph.join(values, "key").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), *[drawn(k).alias(f"p_{k}") for k in KINDS]
        )
        scores = keep(scores, "pii-patterns")
        if turn + 1 < rounds:
            best, mean = ([f(f"p_{k}").alias(f"{n}_{k}") for k in KINDS] for n, f in (("b", F.max), ("m", F.avg)))
            met = graph.join(scores.drop("n"), "pattern").groupBy("key", "kind").agg(*best, *mean)
            found = lambda k: F.when(F.col(f"b_{k}") >= SURE, 1.0).otherwise(F.col(f"m_{k}"))
            own = lambda k: F.when(F.col("kind") == "other", found(k)).otherwise((F.col("kind") == k).cast("double"))
            values = keep(met.select("key", *[own(k).alias(f"s_{k}") for k in KINDS]), "pii-values")
    return scores


def refused(value: Column, kind: Column) -> Column:
    """Whether the pattern of the kind fits the whole value and the kind's test fails."""
    x = F.struct(kind.alias("kind"), value.alias("value"))
    whole = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    fits = [(kind == k) & F.regexp_like(value, F.lit(f"^(?:{p})$")) for k, p in whole.items()]
    return reduce(lambda a, b: a | b, fits) & ~passes(x)


def apart(found: Column) -> Column:
    """Of spans that overlap the one of the best score, then the longest, then the first."""
    order = F.transform(
        found,
        lambda x: F.struct(-x["score"], x["start"] - x["end"], x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    span = "array<struct<kind:string,start:int,end:int>>"
    own = lambda x: F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    over = lambda acc, x: F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    return F.aggregate(F.array_sort(order), F.array().cast(span), lambda acc, x: F.when(over(acc, x), acc).otherwise(F.concat(acc, own(x))))


def discovered(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, tag and the spans that sure patterns report, one row per text that has any."""
    best = F.greatest(*[f"p_{k}" for k in KINDS])
    kind = reduce(lambda a, k: a.when(F.col(f"p_{k}") == best, F.lit(k)), KINDS[1:], F.when(F.col(f"p_{KINDS[0]}") == best, F.lit(KINDS[0])))
    sure = scores.filter(best >= SURE).select("pattern", kind.alias("kind"), best.alias("score"))
    met = rows.select("doc_id", "tag", F.explode("other").alias("x"))
    met = met.select("doc_id", "tag", "x.start", "x.end", "x.value", F.explode(contexts(F.col("x"))).alias("pattern"))
    told = met.join(sure, "pattern").filter(~refused(F.col("value"), F.col("kind")))
    told = told.groupBy("doc_id", "tag", "start", "end").agg(F.max(F.struct("score", "kind")).alias("top"))
    spans = F.collect_list(F.struct(F.col("top.score").alias("score"), F.col("top.kind").alias("kind"), "start", "end"))
    return told.groupBy("doc_id", "tag").agg(apart(spans).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, by start and kind) and base (those of the plain patterns) of
    every row.

    Null text counts as empty; an empty table gives no rows. Rows that share doc_id and text get the
    same spans; equal ids with different texts are told apart by a hash of the text. Spans that the
    method adds overlap neither base spans nor each other. Columns other than doc_id and text are
    ignored, whatever their names. Texts leave their row as spans only.
    """
    rows = keep(read(docs), "pii-rows")
    more = discovered(rows, pattern_scores(edges(rows)))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    joined = rows.alias("r").join(more.alias("m"), F.expr("r.doc_id <=> m.doc_id and r.tag = m.tag"), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    base = slim(F.col("r.known"))
    both = F.concat(base, F.coalesce("m.more", none))
    return joined.select("r.doc_id", "r.tag", ordered(both, KINDS).alias("spans"), ordered(base, KINDS).alias("base"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of touching or overlapping spans replaced by the kind of its first."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        sign = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, sign).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return bound(spans, lambda own: F.when(F.size(own) > 0, F.aggregate(own, begin, step, rest)).otherwise(text))


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, with personal data masked in ``text`` and ``n_chars`` set anew.

    Base spans are found in the row. Only the few spans of learned patterns are joined; Spark sends
    them to the texts or shuffles both by their size.
    """
    rows = keep(read(docs), "pii-rows")
    more = keep(discovered(rows, pattern_scores(edges(rows))), "pii-more")
    more = more.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("more").alias("_more"))
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    wide = docs.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (tag == F.col("_tag")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    base = F.transform(seeds(F.col("text")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = ordered(F.concat(base, F.coalesce("_more", none)), KINDS)
    text = F.when(F.col("text").isNotNull(), masked(F.col("text"), spans))
    # the new text is an array of one, so that it is made once for both columns
    wide = wide.withColumn("_new", F.explode(F.array(text)))
    changed = {"text": F.col("_new")} | ({"n_chars": F.length("_new").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return wide.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])
