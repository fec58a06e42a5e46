"""Text, time, markup and language functions on small inputs."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.functions import text as tx
from tallyloom.functions import timeparts as tp
from tallyloom.functions.vectors import top_index, top_indices
from tallyloom.operators import entities, language, lexicon, runs, sentiment
from tallyloom.sources import csvs, html, logs
from tallyloom.storage import scratch_path


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build(F.col("c"))).first()[0]


def test_clean_text(spark):
    assert one(spark, "Hi @bob_x see http://t.co/a?b=1 città, ok!\n", tx.clean_text) == "Hi x see citt ok"


def test_tags(spark):
    assert one(spark, "['#a', '#b']", tx.parse_tags) == ["#a", "#b"]
    assert one(spark, "[]", tx.parse_tags) == [""]
    assert one(spark, "['#a', '#b']", lambda c: tx.parse_tags(c, strip=False)) == ["'#a'", " '#b'"]
    assert one(spark, "[]", lambda c: tx.real_tags(tx.parse_tags(c))) == []
    assert one(spark, ["B", "a", "b"], tx.lower_distinct, "array<string>") == ["a", "b"]


def test_word_grams(spark):
    words = ["a", "b", "c"]
    for n, want in ((1, words), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])):
        assert one(spark, words, lambda c, n=n: tx.word_grams(c, n), "array<string>") == want
    assert one(spark, [], lambda c: tx.word_grams(c, 2), "array<string>") == []


def test_post_time(spark):
    def parse(raw):
        return one(spark, raw, lambda c: tp.post_timestamp(tp.normal_post_time(c)))

    assert one(spark, "10:05 - 2 giu 2016", tp.normal_post_time) == "10:05 - 02 06 2016"
    assert one(spark, "10:05 - 12 dic 2016", tp.normal_post_time) == "10:05 - 12 12 2016"
    assert one(spark, "no month", tp.normal_post_time) == ""
    assert one(spark, None, tp.normal_post_time) == ""
    assert str(parse("10:05 - 2 giu 2016")) == "2016-06-02 10:05:00"
    for bad in ("", "bad", "10:05 - 2 06 2016"):
        assert one(spark, bad, tp.post_timestamp) is None
    assert str(one(spark, "10:05 - 12 06 2016", tp.post_date)) == "2016-06-12"


def test_counters_and_hours(spark):
    assert [one(spark, c, tp.count_or_zero) for c in ("", "7", None)] == [0, 7, 0]
    assert one(spark, "07:30:00", tp.leading_hour) == 7
    assert one(spark, "x", tp.leading_hour) is None
    assert one(spark, "TimeNotAvailable", tp.null_if_unknown) is None


def test_vectors(spark):
    assert one(spark, [0.1, 0.5, 0.5, 0.2], top_index, "array<double>") == 1
    assert one(spark, [0.1, 0.5, 0.5, 0.2], lambda c: top_indices(c, 3), "array<double>") == [1, 2, 3]


PAGE = """<html><ol>
<li class="js-stream-item stream-item" data-item-id="77"><div class="tweet js" data-screen-name="anna">
<a href="/s" class="tweet-timestamp x" title="9:30 - 3 ago 2017">t</a>
<div class="js-tweet-text-container"><p>Nice &amp; calm <a href="/hashtag/sea" class="h"><s>#</s><b>sea</b></a> today
<a href="http://x">link</a>!</p></div>
<div class="ProfileTweet-action ProfileTweet-action--reply"><span class="ProfileTweet-actionCountForPresentation"></span></div>
<div class="ProfileTweet-action ProfileTweet-action--retweet"><span class="ProfileTweet-actionCountForPresentation">4</span></div>
<div class="ProfileTweet-action ProfileTweet-action--favorite"><span class="ProfileTweet-actionCountForPresentation">12</span></div>
</div></li><li class="js-stream-item" data-item-id="78"><div class="tweet" data-screen-name="bo">
<a class="tweet-timestamp" title="10:05 - 12 giu 2016"></a><div class="js-tweet-text-container">Plain</div></div></li></ol></html>"""


def test_posts_of_pages(spark):
    pages = spark.createDataFrame([("u", PAGE)], "url string, html string")
    rows = html.posts_of_pages(pages).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["77", "78"]
    a, b = rows
    assert (a["creator"], a["hashtags"], a["likes"], a["reshares"], a["num_replies"]) == ("anna", ["#sea"], 12, 4, 0)
    assert a["text"] == "Nice & calm #sea todaylink!"
    assert a["clean_text"] == "Nice & calm  today!"
    assert b["hashtags"] == [] and str(b["ts"]) == "2016-06-12 10:05:00"
    greedy = html.posts_of_pages(pages, greedy=True).orderBy("id").first()
    assert greedy["clean_text"] == "Nice & calm !"


def test_single_digit_hour_is_unreadable(spark):
    """The post format wants two hour digits, so a one-digit hour gives null."""
    pages = spark.createDataFrame([("u", PAGE)], "url string, html string")
    assert html.posts_of_pages(pages).filter("id = '77'").first()["ts"] is None


def test_read_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text(PAGE)
    pages = html.read_pages(spark, str(tmp_path))
    assert "\n" not in pages.first()["html"]
    assert html.posts_of_pages(pages).count() == 2


LINES = [
    "Parking 103(Site A): 120 free parking @Mon Jun 06 2016 10:00:00 GMT+0200 (CEST)",
    "Parking 101(Site B): 7 free parking @Sun Oct 30 2016 23:30:00 GMT+0100 (CET)",
    "Parking 103(Site A): 5 free parking @Tue Jan 05 2016 10:00:00 GMT+0100 (CET)",
    "Parking 103(Site A): 5 free parking @Mon Jun 08 2015 10:00:00 GMT+0200 (CEST)",
]


def test_logs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LINES[::2]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(LINES[1::2]) + "\n")
    sites = spark.createDataFrame([("Parking 103(Site A)", 103, 1), ("Parking 101(Site B)", 101, 4)], "site string, code int, area int")
    got = logs.read_logs(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], sites)
    rows = [tuple(r) for r in logs.positional(got).orderBy("name").collect()]
    assert rows == [(101, 7, "d7", "10", "30", 2016, "23:30:00"), (103, 120, "d1", "06", "06", 2016, "10:00:00")]
    path = scratch_path(spark, "t")
    logs.positional(got).write.csv(path)
    back = csvs.read_parking(spark, path).orderBy("code").collect()
    assert [(r["code"], r["free"], r["hour"], r["month"]) for r in back] == [(101, 7, 23, 10), (103, 120, 10, 6)]


def test_csv_cells(spark):
    rows = [("1", 'say "hi", ok', "a\nb"), ("2", "", None)]
    path = scratch_path(spark, "t")
    csvs.write_csv(spark.createDataFrame(rows, "id string, a string, b string"), path)
    got = csvs.read_csv(spark, path, "id string, a string, b string").orderBy("id").collect()
    assert [tuple(r) for r in got] == rows


def test_csv_carriage_return(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes(b"id,clean_text\r\n1,hello\r\n")
    got = csvs.read_csv(spark, str(tmp_path / "p.csv"), "id string, clean_text string")
    assert [tuple(r) for r in got.collect()] == [("1", "hello")]


def test_flat_lines(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert csvs.flat_lines(df).first()[0] == "1  x"


def test_stop_words_by_language(spark):
    df = spark.createDataFrame([(1, "the casa the lago", "en"), (2, "the il lago", "it"), (3, "il the mare", "un"), (4, None, "en")], "id int, text string, language string")
    lists = {"en": language.default_stop_words("english", ["casa"]), "it": language.default_stop_words("italian", ["lago"])}
    got = language.prepare(df, "text", "language", lists, 1, default="it")
    rows = {r["id"]: r["stopWordFree"] for r in got.collect()}
    assert rows[1] == ["lago"] and rows[2] == ["the"] and rows[3] == ["the", "mare"]


def test_tfidf_equals_mllib(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["b", "c", "d"])], "id int, words array<string>")
    cv = CountVectorizer(inputCol="words", outputCol="tf", minDF=2.0).fit(df)
    idf = IDF(inputCol="tf", outputCol="w").fit(cv.transform(df))
    want = {}
    for r in idf.transform(cv.transform(df)).collect():
        for i, v in zip(r["w"].indices, r["w"].values):
            want[r["id"], cv.vocabulary[i]] = float(v)
    got = {(r["id"], r["term"]): r["weight"] for r in language.tfidf(df, "id", "words").collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in got)


def test_detect_language(spark):
    lists = language.stop_word_table(spark, {"en": ["the", "of"], "it": ["il", "di"]})
    df = spark.createDataFrame([(1, "The end of it"), (2, "il fine di"), (3, "xyz"), (4, ""), (5, None)], "id int, text string")
    got = {r["id"]: r["detected"] for r in language.detect_language(df, "id", "text", lists).collect()}
    assert got == {1: "en", 2: "it", 3: "un", 4: "un", 5: "un"}


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("en", "good", 0.8), ("en", "bad", -1.0), ("it", "bello", 1.0)], "language string, word string, polarity double")
    df = spark.createDataFrame(
        [(1, "good day", "en"), (2, "not good", "en"), (3, "very bad", "en"), (4, "nothing", "en"), (5, "bello non bello", "it"), (6, "good", "fr"), (7, "good bad", "en"), (8, "", "en")],
        "id int, text string, language string",
    )
    got = {r["id"]: r for r in sentiment.sentiment(df, "id", "text", "language", lex, ["not"], {"very": 1.5}).collect()}
    assert got[1]["hybrid"] == 0.8 and got[2]["hybrid"] == -0.4 and got[3]["hybrid"] == -1.0
    assert got[4]["hybrid"] == 0.0 and got[5]["hybrid"] == 1.0 and got[6]["hybrid"] is None
    assert math.isclose(got[7]["plain"], -0.1) and got[8]["plain"] == 0.0


def test_learned_lexicon(spark):
    rnd = random.Random(3)
    words = {"en": ["good", "bad", "fine", "poor", "table", "the"], "it": ["bello", "casa", "mare"]}
    rows = [(i, " ".join(rnd.choices(words[k], k=rnd.randint(0, 12))), k) for i, k in enumerate(["en", "en", "it"] * 60)]
    rows += [(900, None, "en"), (901, "good bad", None), (902, "once only", "en")]
    seeds = [("en", "good", 1.0), ("en", "bad", -0.75), ("it", "bello", 0.5), ("fr", "bon", 1.0)]
    df = spark.createDataFrame(rows, "id int, text string, language string").repartition(4)
    graph = lexicon.near_words(df, "text", "language", 2, 3)
    met = Counter()
    for _, text, lang in rows:
        own = (text or "").split()
        for d in (1, 2):
            for a, b in zip(own, own[d:]):
                if a != b and lang:
                    met[lang, min(a, b), max(a, b)] += 1
    met = {k: n for k, n in met.items() if n >= 3}
    met |= {(k, b, a): n for (k, a, b), n in met.items()}
    assert {(r["language"], r["word"], r["other"]): r["n"] for r in graph.collect()} == met
    fixed = {(k, w): round(p * 1_000_000) for k, w, p in seeds}
    total = Counter()
    for (k, a, _), n in met.items():
        total[k, a] += n
    score = dict(fixed)
    for _ in range(3):
        new = dict(fixed)
        for k, a in total:
            pull = [(n, score[k, y]) for (l, x, y), n in met.items() if (l, x) == (k, a) and (k, y) in score]
            if pull and (k, a) not in fixed:
                s = sum(n * p for n, p in pull)
                new[k, a] = int(math.copysign(abs(s) // total[k, a], s))
        score = new
    want = {w: p for w, p in score.items() if w in fixed or (total[w] >= 30 and abs(p) >= 20_000)}
    lex = spark.createDataFrame(seeds, "language string, word string, polarity double")
    got = {(r["language"], r["word"]): round(r["polarity"] * 1_000_000) for r in lexicon.learned(graph, lex).collect()}
    assert got == want and len(got) > len(seeds)
    assert {r["word"] for r in lexicon.learned(graph.limit(0), lex).collect()} == {"good", "bad", "bello", "bon"}


def test_entities(spark):
    df = spark.createDataFrame([(1, "The boat left Como. Then Villa Olmo, near Bellagio Town, opened."), (2, ""), (3, None)], "id int, text string")
    got = sorted(r["entity"] for r in entities.entities(df, "text", "id").collect())
    assert got == ["Bellagio Town", "Como", "Villa Olmo"]
    known = spark.createDataFrame([("Como",)], "entity string")
    assert entities.entities(df, "text", "id", gazetteer=known).count() == 1


def test_language_model(spark):
    rows = [(i, "the thing that they think", "en") for i in range(5)] + [(i, "gli amici degli egli", "it") for i in range(5, 10)]
    df = spark.createDataFrame(rows, "id int, text string, language string")
    model, names = language.language_model(df, "text", "language")
    got = language.predict_language(df, "text", model, names)
    assert got.filter("language <> predicted").count() == 0


NESTED = """<ol><li data-item-id="79" class="js-stream-item stream-item"><div data-screen-name="cy" class="tweet">
<span class="ProfileTweet-action--retweet u-hidden"><span class="ProfileTweet-actionCount">x</span></span>
<a title="10:05 - 12 giu 2016" class="tweet-timestamp y" data-original-title="none">t</a>
<div dir="ltr" class="js-tweet-text-container"><div><div>one</div> two</div> three</div><div>not this</div>
<div class="ProfileTweet-action ProfileTweet-action--reply"><span data-x="1" class="ProfileTweet-actionCountForPresentation">1.234</span></div>
<div class="ProfileTweet-action ProfileTweet-action--retweet"><span class="ProfileTweet-actionCountForPresentation">12,345,678</span></div>
</div></li></ol>"""


def test_nested_blocks_grouped_counters_and_attribute_order(spark):
    row = html.posts_of_pages(spark.createDataFrame([("u", NESTED)], "url string, html string")).first()
    assert (row["id"], row["creator"], str(row["ts"])) == ("79", "cy", "2016-06-12 10:05:00")
    assert row["text"].split() == ["one", "two", "three"]
    assert (row["num_replies"], row["reshares"], row["likes"]) == (1234, 12345678, 0)


@pytest.fixture(scope="module")
def run_rows(spark):
    rows = [("en", "a b a b c a b".split()), ("en", "b a b".split()), (None, "a b".split()), ("fr", []), ("fr", None), ("fr", ["x"]), (None, "b a".split())]
    return rows * 3, spark.createDataFrame(rows * 3, "language string, words array<string>").repartition(3)


def test_run_counts(run_rows, monkeypatch):
    """Runs end with their text, whatever the blocks; a null key is a group of its own."""
    rows, df = run_rows
    for block in (2, 1 << 21):
        monkeypatch.setattr(runs, "BLOCK", block)
        uses, texts = Counter(), Counter()
        for lang, words in rows:
            own = Counter((lang, n, " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words or []) - n + 1))
            uses.update(own)
            texts.update(own.keys())
        got = runs.run_counts(df, "words", [1, 2, 3], "language").collect()
        assert {(r["language"], r["n"], r["term"]): (r["tf"], r["df"]) for r in got} == {k: (uses[k], texts[k]) for k in uses}
        assert len(got) == len(uses)
        some = runs.run_counts(df, "words", [1, 3], least=7).collect()
        assert {(r["n"], r["term"]) for r in some} == {(1, "a"), (1, "b")}


def test_pair_counts(run_rows, monkeypatch):
    rows, df = run_rows
    monkeypatch.setattr(runs, "BLOCK", 4)
    want = Counter()
    for lang, words in rows:
        for d in (1, 2):
            want.update((lang, *sorted(p)) for p in zip(words or [], (words or [])[d:], strict=False) if p[0] != p[1])
    got = {(r["language"], r["word"], r["other"]): r["n"] for r in runs.pair_counts(df, "words", "language", 2, 4).collect()}
    assert got == {k: n for k, n in want.items() if n >= 4}


@pytest.mark.parametrize("name", ["ngram_counts", "doc_frequency", "vocabulary", "tfidf_terms"])
def test_terms_are_not_exploded(spark, sf, name):
    """Terms are counted before rows are made of them; no shuffle has a row for each place of a text."""
    text = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text


def test_tfidf_of_repeated_keys(spark):
    """Rows with one key are one text, also with a null key."""
    rows = [(1, ["a", "b"]), (1, ["a"]), (2, ["a", "c"]), (None, ["b"]), (None, ["b", "c"]), (3, [])]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    got = {(r["id"], r["term"]): (r["tf"], r["df"]) for r in language.tfidf(df, "id", "words", min_df=1).collect()}
    assert got == {(1, "a"): (2, 2), (1, "b"): (1, 2), (2, "a"): (1, 2), (2, "c"): (1, 2), (None, "b"): (2, 2), (None, "c"): (1, 2)}


def test_fields_of_posts_share_their_parts(spark):
    """The text of a post is cut out once, not for each field made of it."""
    df = spark.createDataFrame([(1, "<html></html>")], "page int, html string")
    plan = html.posts_of_pages(df)._jdf.queryExecution().optimizedPlan().toString()
    # its pieces are counted and joined, 2 places in all
    assert plan.count("js-tweet-text-container") == 2
