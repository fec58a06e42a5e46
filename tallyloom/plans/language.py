"""Words, term weights, language labels, sentiment and entities over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import clean_text, tokens
from tallyloom.operators import counts, entities, language, sentiment, stats
from tallyloom.operators import lexicon as lexicons
from tallyloom.operators.runs import run_counts
from tallyloom.plans.ingest import CLEAN_SQL
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import Tables, texts, with_views
from tallyloom.storage import written

# Short function words of each language and the words of the domain.
STOPS = {
    "en": [
        "the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "as", "are", "was", "be", "by", "on", "this",
        "from", "at", "an", "or", "not", "he", "she", "they", "we", "you", "have", "had", "has", "but", "which",
    ],
    "fr": [
        "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "aux",
        "avec", "est", "en", "ne", "pas", "ce", "il", "elle", "nous", "vous", "ou", "son", "sa",
    ],
    "de": [
        "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "des", "im", "dem", "nicht", "ein", "eine", "als",
        "auch", "es", "an", "auf", "in", "sich", "er", "sie", "wir", "ihr", "bei", "aus", "nach", "wie",
    ],
    "es": [
        "el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "no", "es", "al", "lo",
        "se", "su", "como", "pero", "sus", "le", "ya", "o", "este", "porque", "esta", "entre",
    ],
}
DOMAIN = {"en": ["lake", "house"], "fr": ["lac"], "de": ["see"], "es": ["lago"]}

# A word list for the test texts, which are invented prose: polarities are given to common words.
LEXICON = [
    ("en", "with", 1.0), ("en", "for", 0.5), ("en", "that", 1.0), ("en", "this", 0.5), ("en", "are", 1.0),
    ("en", "was", -1.0), ("en", "from", -0.5), ("en", "it", -1.0), ("en", "at", -0.5), ("en", "good", 1.0),
    ("en", "bad", -1.0), ("fr", "avec", 1.0), ("fr", "pour", 0.5), ("fr", "est", 1.0), ("fr", "dans", 0.5),
    ("fr", "pas", -1.0), ("fr", "sur", -0.5), ("fr", "par", -1.0), ("de", "mit", 1.0), ("de", "ist", 0.5),
    ("de", "ein", 1.0), ("de", "als", 0.5), ("de", "nicht", -1.0), ("de", "von", -0.5), ("de", "auf", -1.0),
    ("es", "con", 1.0), ("es", "para", 0.5), ("es", "una", 1.0), ("es", "no", -1.0), ("es", "por", -0.5),
]
NEGATORS = ["not", "no", "never", "of"]
INTENSIFIERS = {"very": 1.5, "and": 1.3}


def stop_lists() -> dict[str, list[str]]:
    return {lang: words + DOMAIN[lang] for lang, words in STOPS.items()}


def stop_values() -> str:
    """The same lists as SQL values."""
    rows = sorted({(lang, w) for lang, words in stop_lists().items() for w in words})
    cells = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in rows)
    return f"stops AS (SELECT * FROM (VALUES {cells}) s(language, word))"


def lexicon_values() -> str:
    cells = ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in LEXICON)
    return f"lexicon AS (SELECT * FROM (VALUES {cells}) l(language, word, polarity))"


def prepared(t: Tables, n: int = 1):
    return language.prepare(texts(t), "text", "language", stop_lists(), n)


FREE = """free AS (SELECT w.* FROM words w WHERE NOT EXISTS (
  SELECT 1 FROM stops s WHERE s.language = w.language AND s.word = w.word)),
freed AS (SELECT id, language, list(word ORDER BY pos) AS ws FROM free GROUP BY 1, 2)"""

GRAMS = """grams AS (
  SELECT id, language, 1 AS n, unnest(ws) AS term FROM freed
  UNION ALL SELECT id, language, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM freed
  UNION ALL SELECT id, language, 3,
    unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM freed)"""


def free_sql(names: str, body: str, *more: str):
    return lambda: with_views(names, body, ",\n".join([stop_values(), FREE, *more]))


@query("tokenize", with_views("words", """
SELECT x.id, count(w.word) AS n, md5(coalesce(string_agg(w.word, ' ' ORDER BY w.pos), '')) AS words
FROM texts x LEFT JOIN words w ON w.id = x.id GROUP BY 1"""))
def tokenize(t: Tables):
    """Lower-case words of two signs or more."""
    cut = texts(t).select("id", tokens(F.col("text")).alias("w"))
    return cut.select("id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query("stopword_filter", free_sql("words", """
SELECT x.id, count(w.word) AS n, md5(coalesce(string_agg(w.word, ' ' ORDER BY w.pos), '')) AS words
FROM texts x LEFT JOIN free w ON w.id = x.id GROUP BY 1"""))
def stopword_filter(t: Tables):
    """Words left after the stop list of each row's own language."""
    free = prepared(t).select("id", "stopWordFree")
    return free.select(
        "id", F.size("stopWordFree").cast("bigint").alias("n"), F.md5(F.array_join("stopWordFree", " ")).alias("words")
    )


@query("prep_multilang", free_sql("words", """
SELECT language, count(*) AS texts, CAST(sum(a) AS BIGINT) AS tokens, CAST(sum(b) AS BIGINT) AS free,
  CAST(sum(greatest(b - 1, 0)) AS BIGINT) AS bigrams
FROM (SELECT x.id, x.language, count(w.word) AS a, count(w.word) FILTER (s.word IS NULL) AS b
  FROM texts x LEFT JOIN words w ON w.id = x.id LEFT JOIN stops s ON s.language = w.language AND s.word = w.word
  GROUP BY 1, 2) GROUP BY 1"""))
def prep_multilang(t: Tables):
    """All languages prepared in one frame: sizes of the three word columns."""
    return prepared(t, 2).groupBy("language").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.size("tokens")).alias("tokens"),
        F.sum(F.size("stopWordFree")).alias("free"),
        F.sum(F.size("ngrams")).alias("bigrams"),
    )


@query("ngram_counts", free_sql("words", """
SELECT CAST(n AS INT) AS n, language, term, count(*) AS uses FROM grams GROUP BY 1, 2, 3""", GRAMS))
def ngram_counts(t: Tables):
    """Runs of one, two and three words in each language, with their uses."""
    counted = run_counts(prepared(t), "stopWordFree", [1, 2, 3], "language", documents=False)
    return counted.select("n", "language", "term", F.col("tf").alias("uses"))


@query("doc_frequency", free_sql("words", """
SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM grams WHERE n = 2 GROUP BY 1 HAVING count(DISTINCT id) >= 2""", GRAMS))
def doc_frequency(t: Tables):
    """Uses and documents of each word pair found in two documents or more."""
    return language.term_counts(prepared(t), "stopWordFree", n=2, min_df=2)


@query("vocabulary", free_sql("words", """
SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM grams WHERE n = 1 GROUP BY 1 HAVING count(DISTINCT id) >= 2
ORDER BY tf DESC, term LIMIT 10000""", GRAMS))
def vocabulary(t: Tables):
    """The ten thousand most used words found in two documents or more."""
    return language.vocabulary(prepared(t), "ngrams", 10_000)


@query("tfidf_terms", free_sql("words", """
SELECT g.id, g.term, count(*) AS tf, v.df, CAST(round(TRY_CAST(count(*) * ln((m + 1) / (v.df + 1)) AS DECIMAL(28,9)), 6) AS DOUBLE) AS weight
FROM grams g JOIN (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM grams WHERE n = 1 GROUP BY 1
  HAVING count(DISTINCT id) >= 2 ORDER BY tf DESC, term LIMIT 10000) v ON v.term = g.term,
  (SELECT count(*) AS m FROM texts) WHERE g.n = 1 GROUP BY g.id, g.term, v.df, m""", GRAMS))
def tfidf_terms(t: Tables):
    """Weighted terms of every text, over a vocabulary of bounded size."""
    w = language.tfidf(prepared(t).select("id", "ngrams"), "id", "ngrams", 10_000)
    return w.select("id", "term", "tf", "df", steady("weight", 6).alias("weight"))


DETECT = """letters AS (SELECT id, 'full' AS src, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM texts
  UNION ALL SELECT id, 'clean', unnest(regexp_split_to_array(lower(""" + CLEAN_SQL + """), '[^\\p{L}]+')) FROM texts),
hits AS (SELECT id, src, s.language, count(*) AS n FROM letters l JOIN stops s ON s.word = l.word GROUP BY 1, 2, 3),
best AS (SELECT id, src, language AS detected FROM (
  SELECT *, row_number() OVER (PARTITION BY id, src ORDER BY n DESC, language) AS r FROM hits) WHERE r = 1)"""


def detect_sql(body: str):
    return lambda: with_views("texts", body, stop_values() + ",\n" + DETECT)


def stop_table(t: Tables):
    return language.stop_word_table(t.spark, stop_lists())


@query("detect_language", detect_sql("""
SELECT x.id, coalesce(b.detected, 'un') AS detected FROM texts x LEFT JOIN best b ON b.id = x.id AND b.src = 'full'"""))
def detect_language(t: Tables):
    """Language whose stop words occur most, ``un`` without any."""
    return language.detect_language(texts(t), "id", "text", stop_table(t))


@query("label_agreement", detect_sql("""
SELECT coalesce(a.detected, 'un') AS by_text, coalesce(b.detected, 'un') AS by_clean, count(*) AS n
FROM texts x LEFT JOIN best a ON a.id = x.id AND a.src = 'full' LEFT JOIN best b ON b.id = x.id AND b.src = 'clean'
GROUP BY 1, 2"""))
def label_agreement(t: Tables):
    """Labels from the full text against labels from the cleaned text."""
    x = texts(t).select("id", "text", clean_text(F.col("text")).alias("clean"))
    lists = stop_table(t)
    full = language.detect_language(x, "id", "text", lists, "by_text")
    clean = language.detect_language(x, "id", "clean", lists, "by_clean")
    return counts.label_agreement(full.join(clean, "id"), "by_text", "by_clean")


@query("detect_language_nb")
def detect_language_nb(t: Tables):
    """Naive Bayes over letter runs: given against predicted labels."""
    x = texts(t).select("id", "text", "language")
    model, names = language.language_model(x, "text", "language")
    return counts.label_agreement(language.predict_language(x, "text", model, names), "language", "predicted")


def lexicon(t: Tables):
    return t.spark.createDataFrame(LEXICON, "language string, word string, polarity double")


POLAR = r"""cut AS (SELECT id, language, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 1) AS ws FROM texts),
spelt AS (SELECT id, language, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos, unnest(list_prepend('', ws)[1:len(ws)]) AS before FROM cut),
polar AS (SELECT s.*, l.polarity, CASE WHEN before IN ('not', 'no', 'never', 'of') THEN l.polarity * -0.5
    WHEN before = 'very' THEN greatest(-1.0, least(1.0, l.polarity * 1.5))
    WHEN before = 'and' THEN greatest(-1.0, least(1.0, l.polarity * 1.3)) ELSE l.polarity END AS changed
  FROM spelt s JOIN lexicon l ON l.language = s.language AND l.word = s.word),
scored AS (SELECT x.id, x.language, x.text, x.day, coalesce(avg(p.polarity), 0) AS plain, coalesce(avg(p.changed), 0) AS with_context
  FROM texts x LEFT JOIN polar p ON p.id = x.id GROUP BY 1, 2, 3, 4)"""


def polar_sql(body: str, *more: str) -> str:
    return with_views("texts", body, ",\n".join([lexicon_values(), POLAR, *more]))


def scored_texts(t: Tables):
    return sentiment.sentiment(texts(t), "id", "text", "language", lexicon(t), NEGATORS, INTENSIFIERS)


@query("word_polarity", polar_sql("""
SELECT id, CAST(pos AS INT) AS pos, word, polarity FROM polar"""))
def word_polarity(t: Tables):
    """Every polar word with its place and polarity."""
    return sentiment.polar_words(texts(t), "id", "text", "language", lexicon(t)).select("id", "pos", "word", "polarity")


@query("lexicon_sentiment", polar_sql("SELECT id, round(plain, 9) AS score FROM scored"))
def lexicon_sentiment(t: Tables):
    """Mean polarity of the polar words, 0 without any."""
    return scored_texts(t).select("id", F.round("plain", 9).alias("score"))


@query("sentiment_negation", polar_sql("""
SELECT id, round(with_context, 9) AS score FROM scored WHERE language = 'en'"""))
def sentiment_negation(t: Tables):
    """English texts scored with negation and strengthening words."""
    english = scored_texts(t).filter("language = 'en'")
    return english.select("id", F.round("with_context", 9).alias("score"))


@query("hybrid_sentiment", polar_sql("""
SELECT id, language, round(CASE WHEN language = 'en' THEN with_context ELSE plain END, 9) AS score FROM scored"""))
def hybrid_sentiment(t: Tables):
    """One score per text by the rule of its language."""
    return scored_texts(t).select("id", "language", F.round("hybrid", 9).alias("score"))


def spread_sql(rounds: int = 3) -> str:
    """The learned lexicon, a table expression for each round."""
    steps = []
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS (SELECT language, word, score FROM fixed UNION ALL
  SELECT g.language, g.word, CAST(sign(sum(n * score)) * (abs(sum(n * score)) // any_value(total)) AS BIGINT)
  FROM graph g JOIN r{i - 1} s ON s.language = g.language AND s.word = g.other
    JOIN totals t ON t.language = g.language AND t.word = g.word
  WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.language = g.language AND f.word = g.word) GROUP BY 1, 2)""")
    return ",\n".join(steps)


LEARNED = r"""toks AS (SELECT id, language, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 1) AS ws FROM texts),
spread AS (SELECT language, unnest(ws) AS a, unnest(list_concat(ws[2:len(ws)], [NULL])) AS b FROM toks
  UNION ALL SELECT language, unnest(ws), unnest(list_concat(ws[3:len(ws)], [NULL, NULL])[1:len(ws)]) FROM toks),
half AS (SELECT language, least(a, b) AS word, greatest(a, b) AS other, count(*) AS n FROM spread
  WHERE b IS NOT NULL AND a <> b AND language IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3),
graph AS (SELECT * FROM half UNION ALL SELECT language, other, word, n FROM half),
totals AS (SELECT language, word, sum(n) AS total FROM graph GROUP BY 1, 2),
fixed AS (SELECT language, word, CAST(round(polarity * 1000000) AS BIGINT) AS score FROM lexicon),
r0 AS (SELECT * FROM fixed),
""" + spread_sql() + """,
learned AS (SELECT language, word, score FROM fixed UNION ALL SELECT r.language, r.word, r.score
  FROM r3 r JOIN totals t ON t.language = r.language AND t.word = r.word
  WHERE total >= 30 AND abs(score) >= 20000 AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.language = r.language AND f.word = r.word))"""


def learned_lexicon(t: Tables):
    graph = lexicons.near_words(texts(t), "text", "language")
    return lexicons.learned(graph, lexicon(t))


@query("sentiment_lexicon", with_views("texts", "SELECT language, word, score AS millionths FROM learned", lexicon_values() + ",\n" + LEARNED))
def sentiment_lexicon(t: Tables):
    """Words that seeds give a polarity over a graph of neighbours, with it."""
    return learned_lexicon(t).select("language", "word", F.round(F.col("polarity") * lexicons.MILLION).cast("bigint").alias("millionths"))


LEARNED_POLAR = POLAR.replace("JOIN lexicon l", "JOIN (SELECT language, word, score / 1000000 AS polarity FROM learned) l")


@query("sentiment_learned", with_views("texts", """
SELECT id, language, CAST(round(TRY_CAST(CASE WHEN language = 'en' THEN with_context
  WHEN language IN (SELECT language FROM lexicon) THEN plain END AS DECIMAL(28,9)), 6) AS DOUBLE) AS score
FROM scored""", ",\n".join([lexicon_values(), LEARNED, LEARNED_POLAR])))
def sentiment_learned(t: Tables):
    """One score per text with the learned lexicon."""
    words = written(learned_lexicon(t), "lexicon")
    scored = sentiment.sentiment(texts(t), "id", "text", "language", words, NEGATORS, INTENSIFIERS)
    return scored.select("id", "language", steady("hybrid").alias("score"))


@query("sentiment_tails", polar_sql("""
SELECT count(*) AS n, CAST(round(TRY_CAST(avg(CASE WHEN s < -0.25 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS very_negative,
  CAST(round(TRY_CAST(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS negative, CAST(round(TRY_CAST(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS positive,
  CAST(round(TRY_CAST(avg(CASE WHEN s > 0.25 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS very_positive
FROM (SELECT CASE WHEN language = 'en' THEN with_context ELSE plain END AS s FROM scored)"""))
def sentiment_tails(t: Tables):
    """Parts of texts in the tails of the hybrid score."""
    return stats.tail_shares(scored_texts(t), "hybrid", 0.25).select(
        "n", *[steady(c, 6).alias(c) for c in ("very_negative", "negative", "positive", "very_positive")]
    )


MENTION = "regexp_extract_all(text, '[a-z,] ([A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)*)', 1)"


@query("entity_counts", with_views("texts", f"""
SELECT language, entity, count(*) AS n FROM (SELECT language, unnest({MENTION}) AS entity FROM texts) GROUP BY 1, 2"""))
def entity_counts(t: Tables):
    """Mentions of names per language."""
    return entities.entity_counts(texts(t), "text", "language")


@query("entities_per_day", with_views("texts", f"""
SELECT day, entity, count(*) AS n FROM (SELECT day, unnest({MENTION}) AS entity FROM texts) GROUP BY 1, 2"""))
def entities_per_day(t: Tables):
    """Mentions of names per day."""
    return entities.entity_counts(texts(t), "text", "day")


@query("entity_gazetteer", with_views("texts", f"""
SELECT language, entity, count(*) AS n FROM (SELECT language, unnest({MENTION}) AS entity FROM texts)
WHERE entity IN ('Apache License', 'MIT License', 'Inc', 'Lake') GROUP BY 1, 2"""))
def entity_gazetteer(t: Tables):
    """Mentions checked against a list of known names."""
    known = t.spark.createDataFrame([("Apache License",), ("MIT License",), ("Inc",), ("Lake",)], "entity string")
    return entities.entity_counts(texts(t), "text", "language", gazetteer=known)


@query("anti_join_terms", polar_sql(f"""
SELECT DISTINCT language, entity FROM mentions m WHERE score > 0 AND NOT EXISTS (
  SELECT 1 FROM mentions o WHERE o.language = m.language AND o.entity = m.entity AND o.score < 0)""", f"""
mentions AS (SELECT language, CASE WHEN language = 'en' THEN with_context ELSE plain END AS score,
  unnest({MENTION}) AS entity FROM scored)"""))
def anti_join_terms(t: Tables):
    """Names found in positive texts but in no negative text, per language."""
    scored = texts(t).select("id", "text").join(scored_texts(t), "id")
    found = entities.entities(scored, "text", "language", "hybrid")
    return counts.terms_not_in(found.filter("hybrid > 0"), found.filter("hybrid < 0"), ["language", "entity"])
