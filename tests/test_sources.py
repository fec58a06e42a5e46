"""Multi-line CSV over many tasks against Spark's own reader of whole files."""

import random

import pytest

from tallyloom.sources import csvs, html
from tallyloom.sources.named import register
from tallyloom.storage import scratch_path

SCHEMA = "a int, b string, c string, d double"


def cell(rnd):
    words = ["plain", "with, comma", "two\nlines", 'a "quoted" word', "", "\r\n", "é漢", "\n\n\n", "x" * 300, 'ends with "']
    return None if rnd.random() < 0.1 else "".join(rnd.choices(words, k=rnd.randint(0, 4)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    out = [(i, cell(rnd), cell(rnd), i / 7) for i in range(400)]
    # a cell longer than several blocks
    return [*out, (400, "long\n" * 2000, "tail", 1.0), *[(i, cell(rnd), "z", None) for i in range(401, 450)]]


@pytest.mark.parametrize("block", ["512", "4k", "128m"])
def test_blocks_read_as_whole_files(spark, rows, block):
    path = scratch_path(spark, "csv")
    csvs.write_csv(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    whole = spark.read.schema(SCHEMA).options(header=True, multiLine=True, **csvs.DIALECT).csv(path).collect()
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        tasks = spark.read.text(path).rdd.getNumPartitions()
        got = csvs.read_csv(spark, path, SCHEMA).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert tasks > 20 or block != "512"
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, whole), key=key)
    assert len(got) == len(rows)


def test_foreign_file(spark, tmp_path):
    """Carriage returns at line ends, a header with a line end, empty lines and no last line end."""
    (tmp_path / "a.csv").write_bytes(b'"x\n1",y\r\n1,"p\r\nq"\r\n\r\n2,r\r\n3,"s"')
    got = csvs.read_csv(spark, str(tmp_path), "x int, y string").collect()
    assert sorted(map(tuple, got)) == [(1, "p\r\nq"), (2, "r"), (3, "s")]


def test_no_rows(spark):
    path = scratch_path(spark, "csv")
    csvs.write_csv(spark.createDataFrame([], SCHEMA), path)
    assert csvs.read_csv(spark, path, SCHEMA).collect() == []


ODD = """<html><head><title lang='x>y'>Fish &amp; chips</title><style>p{a>b}</style></head><body><!-- <h1>no</h1> <a href="/no">x</a> -->
<h1 data-x="1 > 0" class=big>Real <b title='a>b'>head</b></h1><script>if (a < b) { document.write('<a href="/script">') }</script>
<img alt="5 > 3" src=x><br><p>one<p>2 < 3 and 4 > 3 <a title='say href="/fake" > here' href='/one?a=1&amp;b=2'>first</a>
<A HREF=/two>second</A><a name="top">none</a><!-- open <a href="/never">"""


def test_markup_with_quotes_comments_and_open_elements(spark):
    row = html.page_fields(spark.createDataFrame([(ODD.replace("\n", " "),), (None,), ("",)], "html string")).collect()
    assert row[0]["title"] == "Fish &amp; chips" and row[0]["heading"] == "Real head"
    assert row[0]["links"] == ["/one?a=1&b=2", "/two"]
    assert row[0]["visible"] == "Fish &amp; chips Real head one 2 < 3 and 4 > 3 first second none"
    assert row[2]["visible"] == "" and row[2]["links"] == [] and row[1]["links"] is None


POST = """<ol><li title="a > b" class="js-stream-item" data-item-id="7"><div data-screen-name="kim" class='x>y'></div>
<a title="10:05 - 12 giu 2016" data-x="1>2" class="tweet-timestamp"></a>
<div lang="it" data-y='<div class="js-tweet-text-container">' class="js-tweet-text-container"><p>we say <img alt="a>b"><!-- <div> --> 1 &lt; 2<br>
<div>in <a data-z=">" href="/hashtag/t"><s>#</s>tag</a></div> end</div> out</div></li></ol>"""


def test_posts_with_odd_attributes(spark):
    row = html.posts_of_pages(spark.createDataFrame([("u", POST)], "url string, html string")).collect()
    assert len(row) == 1 and (row[0]["id"], row[0]["creator"], row[0]["hashtags"]) == ("7", "kim", ["#tag"])
    assert row[0]["text"] == "we say  1 < 2in #tag end" and "10:05" in str(row[0]["ts"])


def test_long_tags_are_linear(spark):
    page = "<a " + 'x="y>" ' * 20_000 + 'href="/end">t</a>' + "<" * 50_000 + "<!--" * 20_000
    row = html.page_fields(spark.createDataFrame([(page,)], "html string")).first()
    assert row["links"] == ["/end"]


def test_named_frames(spark):
    assert register(some_frame=spark.range(3), other=spark.range(2)) == ["other", "some_frame"]
    register(some_frame=spark.range(5))
    assert spark.sql("SELECT count(*) FROM some_frame JOIN other USING (id)").first()[0] == 2
    assert spark.table("some_frame").count() == 5
    with pytest.raises(ValueError):
        register(**{"no name": spark.range(1)})
