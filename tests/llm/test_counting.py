"""Token counts by state maps, divergence by cells, and negatives by cover trees against plain versions."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import __spark_entry__ as entry
from tallyloom.llm import divergence, negatives, tokencount
from tallyloom.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def strange_texts(n, seed=3):
    rnd = random.Random(seed)
    known = list(tokencount.pieces_of(MODEL))
    out = ["", None, " ", "   ", "a  b ", "▁▁ x", "é\x00\n\n 中文字 ", "<s> </s> <0x0A> <unk> ▁", "ﬁ １２　\xa0", "\n", "a\r\nb\t\tc"]
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.5:
            out.append("".join(rnd.choice("ab  cde\nthine▁rstoé中1=🙂") for _ in range(rnd.randint(0, 60))))
        else:
            out.append("".join(rnd.choice(known) for _ in range(rnd.randint(0, 12))))
    return out


def test_counts_are_the_librarys(library):
    texts = strange_texts(2000)
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "doc_id": list(range(len(texts))), "text": texts})
    found = tokencount.Counter(MODEL).batch(batch).to_pylist()
    assert [r["map"][0]["n"] for r in found] == [len(library.encode(t or "")) for t in texts]


def test_state_maps_compose_to_the_run(library, monkeypatch):
    monkeypatch.setattr(tokencount, "STRIDE", 3)
    machine = tokencount.Transducer(tokencount.pieces_of(MODEL))
    for text in strange_texts(500, 5):
        run = tokencount.WORD_SIGN + (text or "x").replace(" ", tokencount.WORD_SIGN)
        here = {0: 0}
        for at in range(0, len(run), 7):
            there = {}
            for a, b, n in machine.state_map(run, at, min(at + 7, len(run))):
                if a in here:
                    assert b not in there
                    there[b] = here[a] + n
            here = there
        assert here == {0: len(library.encode(text or "x"))}


def test_unbroken_runs(spark, library):
    rnd = random.Random(2)
    long = ["".join(rnd.choice("abcdefghij0123456789+/") for _ in range(150_000)), " " * 20_000, "ab" * 40_000 + " tail " + "é" * 9_000, "x"]
    rows = [(i, t, 1, 2, "m") for i, t in enumerate(long)] + [(0, long[0], 1, 2, "m"), (None, None, 1, 2, "m"), (None, long[2], 1, 2, "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int, frag int, map string")
    found = sorted(map(tuple, tokencount.count(docs, MODEL).collect()), key=str)
    want = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in rows]
    assert found == sorted(want, key=str)
    assert tokencount.count(docs.limit(0), MODEL).collect() == []


def test_op11(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = entry.queries()["op11_tokens"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def plain_audit(rows, least=10, top=10):
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    docs, per_lang, per_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for t, a, s in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(t))
        docs[a].update(set(words))
        per_lang[a].update(words)
        per_group[a, s].update(words)
    out = []

    def share(counts, kept):
        total = sum(counts[w] for w in kept)
        return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

    for a, s in {r[1:] for r in rows}:
        kept = [w for w, n in docs[a].items() if n >= least]
        p, q = share(per_group[a, s], kept), share(per_lang[a], kept)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        own = {}
        for b in {r[2] for r in rows if r[1] == a and r[2] != s}:
            other = share(per_group[a, b], kept)
            own[b] = sum(f(p[w], other[w]) for w in kept)
        terms = {w: f(p[w], q[w]) for w in kept if per_group[a, s][w] and p[w] > q[w]}
        for part, items, most in (("pair", own, None), ("term", terms, top)):
            ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(a, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows():
    rnd = random.Random(4)
    words = ["the", "The", "été", "ÉTÉ", "a1b", "漢字", "x", "it's"] + [f"w{chr(97 + i)}" for i in range(26)]
    out = []
    for _ in range(600):
        lang, source = rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["a", "a", "a", "b", "é", None, ""])
        out.append((" ".join(rnd.choices(words, k=rnd.randint(0, 12))), lang, source))
    return [*out, (None, "de", "z"), ("", "de", "y"), ("word", "it", "only"), out[0], out[0], ("rare " * 5000, "en", "a")]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_divergence_is_the_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")
    for least, top in ((10, 10), (200, 3), (10_000, 10)):
        found = [tuple(r) for r in divergence.audit(docs.repartition(5), least, top).collect()]
        assert sorted(found) == plain_audit(rows, least, top)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_keep_to_64_bits(spark):
    n = 4_000_000_000_000_000
    row = spark.createDataFrame([(n // 3, n, 1000)], "c bigint, t bigint, v bigint")
    found = row.select(divergence.share(*(row[x] for x in "ctv"))).first()[0]
    want = 1 + 10**9 * (n // 3 + 2) // (n + 2000)
    assert found == want == divergence.shares(np.array([[n // 3]]), np.array([n]), 1000)[0, 0]


def plain_negatives(rows, every=100, k=5, m=10):
    own = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        cell = (lab, [int(np.floor(256 * x)) for x in v])
        own[i] = min(own.get(i, cell), cell)
    out = []
    for a, (lab, v) in own.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in own.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if own[b][0] == lab][:k]:
            fit = [b for b in order if own[b][0] != lab and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:m]
            out += [(a, p, r, b, score[p], score[b]) for r, b in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=900, d=6):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(8, d))
    out = []
    for i in range(n):
        v = base[rnd.integers(8)] + 0.4 * rnd.normal(size=d) if rnd.random() < 0.7 else base[0]
        out.append((i * 5, [float(x) for x in v], int(rnd.integers(4))))
    out += [(1, None, 1), (2, [], 1), (3, [1.0], None), (4, [float("nan")] * d, 1), (6, [None, 1.0], 1), (None, [1.0] * d, 1)]
    return out + [(8, [1.5] * (d + 3), 2), (9, [0.0] * d, 2), out[0], (200, [0.5] * d, 0), (11, [float("inf")], 1), (300_000, [-x for x in out[0][1]], 3)]


@pytest.mark.parametrize("part, opened", [(2048, 128), (40, 4)])
def test_negatives_are_the_plain_ones(spark, monkeypatch, part, opened):
    monkeypatch.setattr(negatives, "PART", part)
    monkeypatch.setattr(negatives, "OPEN", opened)
    rows = vectors(1)
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "vec_id bigint, embedding array<double>, label int, part int, slice string")
    assert sorted(map(tuple, negatives.mine(df).collect())) == plain_negatives(rows)
    assert negatives.mine(df.limit(0)).collect() == []


def test_radii_cover_what_lies_below():
    rnd = np.random.default_rng(5)
    x = np.floor(rnd.normal(size=(500, 4)) * 100)
    x[100:200] = x[0]
    tree = negatives.CoverTree(np.arange(500), rnd.integers(0, 3, 500), x)
    assert sorted([*tree.child, 0]) == list(range(500))
    opened = 0

    class All(negatives.Best):
        def wants(self, low, high):
            nonlocal opened
            opened += 1
            return super().wants(low, high)

    for q in np.floor(rnd.normal(size=(20, 4)) * 100):
        best = All(-1, 9, q, False, [(-negatives.FAR, negatives.FAR)], 7)
        tree.search(best)
        score = tree.x @ q
        want = sorted(zip(-score, tree.ids))[:7]
        assert [(int(-s), int(i)) for i, s in zip(*best.found[0])] == [(int(s), int(i)) for s, i in want]


def test_large_components_stay_exact():
    column = pa.array([[1 << 30, 3], [-(1 << 30), 5, 7]], pa.list_(pa.int64()))
    rows = negatives.matrix(column)
    assert negatives.products(rows, rows[0]).tolist() == [(1 << 60) + 9, -(1 << 60) + 15]
