"""Item sets, topics and regressors on planted data."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyloom.functions.vectors import as_array
from tallyloom.operators import components, patterns, regression, runs, topic_model, topic_sweep, topics
from tallyloom.sources.models import load_model, model_path, save_model
from tallyloom.storage import scratch_path, small_side


@pytest.fixture(scope="module")
def baskets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        items = [c for c in "abcdef" if rng.random() < 0.3]
        if rng.random() < 0.4:
            items += ["X", "x", "y", ""]
        rows.append((i % 2, items))
    return spark.createDataFrame(rows, "g int, items array<string>")


def test_itemsets_and_rules(baskets):
    model = patterns.mine(baskets, "items", 0.05)
    sets = {tuple(r["items"]): r["freq"] for r in patterns.itemsets(model).collect()}
    plain = [{i.lower() for i in r["items"] if i} for r in baskets.collect()]
    want = {}
    for k in (1, 2, 3):
        for combo in itertools.combinations("abcdefxy", k):
            n = sum(set(combo) <= b for b in plain)
            if n >= 0.05 * len(plain):
                want[combo] = n
    assert {s: n for s, n in sets.items() if len(s) <= 3} == want
    rule = {(tuple(r["antecedent"]), r["consequent"]): r["confidence"] for r in patterns.rules(model).collect()}
    assert rule[("x",), "y"] == 1.0


def test_itemset_tables(baskets):
    sets = patterns.itemsets(patterns.mine(baskets, "items", 0.05))
    assert patterns.in_band(sets, 0, 10**6).count() == sets.count()
    per = {r["size"]: r["n"] for r in patterns.size_stats(sets).collect()}
    assert per[1] == 8
    assert per[None] == sets.count()


def plain_closed(rows, support):
    """Closed sets of each group as the distinct intersections of its baskets."""
    out = set()
    for g in {g for g, _ in rows}:
        own = [frozenset(i.lower() for i in b or [] if i and i.strip()) for h, b in rows if h == g]
        closed = set()
        for b in own:
            closed |= {b} | {b & c for c in closed}
        for c in closed - {frozenset()}:
            n = sum(c <= b for b in own)
            if n >= support * len(own):
                out.add((g, tuple(sorted(c)), len(c), n))
    return out


@pytest.mark.parametrize("support", [0.05, 0.3])
def test_closed_sets(spark, support):
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(160):
        items = [c for c in "abcdef" if rng.random() < 0.4]
        items += passage if i % 3 == 0 else passage[:200] if i % 7 == 0 else []
        items += ["X", "x", "y", ""] if rng.random() < 0.4 else []
        rows.append((["u", "v", None][i % 3 if i > 20 else 0], [str(x) for x in rng.permutation(items)]))
    rows += [("w", None), ("w", []), ("all", ["k", "l"]), ("all", ["l", "k"]), ("all", ["k", "l", "m"])]
    df = spark.createDataFrame(rows, "g string, items array<string>")
    got = patterns.closed_sets(df.repartition(6), "g", "items", support).collect()
    found = [(r["g"], tuple(r["items"]), r["size"], r["freq"]) for r in got]
    assert len(found) == len(set(found))
    assert set(found) == plain_closed(rows, support)
    assert patterns.closed_sets(df.limit(0), "g", "items", support).count() == 0


@pytest.mark.parametrize("held", [0, 12, 2_000_000])
def test_closed_sets_held(spark, monkeypatch, held):
    """Deep sets take no table a level where their baskets fit a task, and are the same where they do not."""
    monkeypatch.setattr(patterns, "HELD", held)
    rows = [[c for j, c in enumerate("abcdefg") if j != i] for i in range(7)] + [list("abcdefg"), ["a"], ["g", "h"]]
    tables = []
    keep = patterns.written
    monkeypatch.setattr(patterns, "written", lambda df, label: tables.append(label) or keep(df, label))
    df = spark.createDataFrame([("x", r) for r in rows], "g string, items array<string>")
    found = patterns.closed_sets(df, "g", "items", 0.1)
    got = {(r["g"], tuple(r["items"]), r["size"], r["freq"]) for r in found.collect()}
    assert got == plain_closed([("x", r) for r in rows], 0.1)
    assert held < 1000 or len(tables) <= 10


@pytest.mark.parametrize("cells", [40, 2_000_000])
def test_sets_that_wait(monkeypatch, cells):
    """A task that has found enough gives back the sets that wait, and the tasks that get them find the rest, none twice."""
    monkeypatch.setattr(patterns, "ROUND", 30)
    monkeypatch.setattr(patterns, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = [tuple(np.flatnonzero(rng.random(16) < 0.8) + 1) for _ in range(60)]
    rows = [(1, *(i + 1 for i in r)) for r in rows]
    state = {"_g": "v", "set": "1", "least": 6, "last": 1, "freq": 60, "closure": []}
    waiting = [[{**state, "items": [int(i) for i in r], "w": 1} for r in rows]]
    kinds = pa.schema([("_g", pa.string()), ("set", pa.string()), ("least", pa.int64()), ("last", pa.int32()), ("freq", pa.int64())]
        + [("closure", pa.list_(pa.int32())), ("items", pa.list_(pa.int32())), ("w", pa.int64())])
    got, rounds = [], 0
    while waiting:
        out = list(patterns.grown_whole(iter([pa.RecordBatch.from_pylist(waiting.pop(), kinds)])))
        new = [r for b in out for r in b.to_pylist()]
        got += [(tuple(sorted(r["closure"])), r["freq"]) for r in new if r["items"] is None]
        names = {r["set"] for r in new if r["items"] is not None}
        waiting += [[r for r in new if r["set"] == n] for n in sorted(names)]
        rounds += 1
    assert rounds > 10
    assert len(got) == len(set(got))
    assert set(got) == {(c, n) for _, c, _, n in plain_closed([("v", [chr(64 + i) for i in r]) for r in rows], 0.1) for c in [tuple(ord(x) - 96 for x in c)]}


@pytest.mark.parametrize("told", [3, 1 << 20])
def test_top_runs(spark, monkeypatch, told):
    """Runs counted by hashes are those that plain counts give, ties by term; so are those counted as text."""
    monkeypatch.setattr(runs, "TOLD", told)
    monkeypatch.setattr(runs, "ADDED", 40)
    monkeypatch.setattr(runs, "PIECE", 50)
    rng = np.random.default_rng(8)
    texts = [[f"w{i}é" for i in rng.zipf(1.6, rng.integers(0, 30)) if i < 60] for _ in range(80)] + [None, [], ["w1é"]]
    df = spark.createDataFrame([(t,) for t in texts], "words array<string>").repartition(3)
    got = runs.top_runs(df, "words", [1, 2, 3, 40], 25, 2)
    assert sorted(got) == [1, 2, 3]
    for n in (1, 2, 3):
        grams = [[" ".join(t[i : i + n]) for i in range(len(t) - n + 1)] for t in texts if t]
        total, per = Counter(g for t in grams for g in t), Counter(g for t in grams for g in set(t))
        want = sorted([g for g in total if per[g] >= 2], key=lambda g: (-total[g], g))[:25]
        assert got[n].terms == want
        assert got[n].df.tolist() == [per[g] for g in want]
    assert runs.top_runs(df.limit(0), "words", [1], 25) == {}


@pytest.mark.parametrize("n", [1, 2])
def test_features_are_those_of_mllib(spark, monkeypatch, n):
    """Without MLlib's table of all term counts, the weights are the same; every row has its own."""
    monkeypatch.setattr(topic_model, "PIECE", 40)
    rng = np.random.default_rng(2)
    texts = [[f"w{i}" for i in rng.integers(0, 12, rng.integers(0, 20))] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, words array<string>").repartition(3)
    plain = Pipeline(stages=topics.feature_stages("words", n=n)).fit(df)
    terms = plain.stages[-2].vocabulary
    want = {r["id"]: {terms[i]: v for i, v in zip(r["features"].indices, r["features"].values) if v > 0} for r in plain.transform(df).collect()}
    own = topic_model.Features("words", n=n).fit(df)
    assert sorted(own.vocabulary) == sorted(terms)
    got = {r["id"]: {own.vocabulary[i]: v for i, v in zip(*r["features"], strict=True)} for r in own.transform(df, "id").collect()}
    assert sorted(got) == sorted(want)
    for i, row in want.items():
        assert got[i] == pytest.approx(row)


def test_planted_topics(spark):
    rng = np.random.default_rng(6)
    vocab = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]]
    docs = [(i, [str(w) for w in rng.choice(vocab[i % 2], 20)]) for i in range(60)]
    df = spark.createDataFrame(docs, "id int, words array<string>")
    model = topics.fit_topics(df, "words", 2, n=1)
    terms = topics.topic_terms(model, 5).collect()
    for t in (0, 1):
        assert len({r["term"][0] for r in terms if r["topic"] == t}) == 1
    scored = model.transform(df).select("id", as_array(F.col("topicDistribution")).alias("w"))
    first = {r["id"]: r["top_topic"] for r in topics.assign(scored, F.col("w"), 2).collect()}
    assert len({first[i] for i in range(0, 60, 2)}) == 1 and first[0] != first[1]


def test_topic_passes(spark, monkeypatch):
    """Passes over blocks give what one loop over all terms gives, and inference is that of each text alone."""
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(topic_model, "TERMS", 20)
    monkeypatch.setattr(topic_model, "SLICE", 3)
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, (40, 7)) * rng.random((40, 7))
    counts[[0, 5, 39]] = 0
    rows = [(i, Vectors.sparse(7, {int(j): float(c[j]) for j in np.flatnonzero(c)})) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(3)
    begin = topic_model.fit(df, "features", 3, 7, 0, 1)
    assert begin.sum() == pytest.approx(counts.sum(), rel=1e-5)
    likelihood = []
    for n in (1, 4, 12):
        words = topic_model.fit(df, "features", 3, 7, n, 1)
        assert words.sum(axis=0) == pytest.approx(counts.sum(axis=0), rel=1e-4)
        factors = (words + 0.1) / (words + 0.1).sum(axis=1, keepdims=True)
        texts = counts.sum(axis=1, keepdims=True) / 3 * np.ones(3) + 50 / 3
        for _ in range(50):
            cells = texts[:, :, None] * factors
            texts = (cells / cells.sum(axis=1, keepdims=True) * counts[:, None, :]).sum(axis=2) + 50 / 3
        theta = texts / texts.sum(axis=1, keepdims=True)
        likelihood.append((counts * np.log(theta @ factors)).sum() + 50 / 3 * np.log(theta).sum() + 0.1 * np.log(factors).sum())
    assert likelihood == sorted(likelihood)
    some = counts.sum(axis=1) > 0
    block = [(np.flatnonzero(c), c[c > 0]) for c in counts[some]]
    factors = np.exp(topic_sweep.digamma(words) - topic_sweep.digamma(words.sum(axis=1, keepdims=True)))
    got = topic_model.infer(
        np.concatenate([b[0] for b in block]), np.concatenate([b[1] for b in block]), np.array([len(b[0]) for b in block]), factors, 50 / 3 + 1
    )
    for own, c in zip(got, counts[some], strict=True):
        gamma = np.ones(3)
        for _ in range(500):
            theta = np.exp(topic_sweep.digamma(gamma) - topic_sweep.digamma(gamma.sum()))
            gamma = theta * (factors @ (c / (theta @ factors))) + 50 / 3 + 1
        assert own == pytest.approx(gamma / gamma.sum(), abs=1e-3)


def plain_bound(docs, k, size, weights, passes, updates):
    """Variational inference text by text; the bound of the fitted model."""
    prior = 1 / k
    for last in [False] * passes + [True]:
        elog = topic_sweep.digamma(weights) - topic_sweep.digamma(weights.sum(axis=1, keepdims=True))
        new, bound = np.full((k, size), prior), 0.0
        for doc in docs:
            gamma = np.full(k, prior + sum(doc.values()) / k)
            for _ in range(updates + 1):
                theta = np.exp(topic_sweep.digamma(gamma) - topic_sweep.digamma(gamma.sum()))
                phi = {w: theta * np.exp(elog[:, w]) for w in doc}
                after = prior + sum(c * phi[w] / phi[w].sum() for w, c in doc.items())
                if _ == updates:
                    break
                gamma = after
            for w, c in doc.items():
                new[:, w] += c * phi[w] / phi[w].sum()
            lg = topic_sweep.log_gamma
            bound += sum(c * np.log(phi[w].sum()) for w, c in doc.items())
            bound += ((prior - gamma) * np.log(theta) + lg(gamma) - lg(prior)).sum() + lg(1.0) - lg(gamma.sum())
        if last:
            lg = topic_sweep.log_gamma
            bound += ((prior - weights) * elog + lg(weights) - lg(prior)).sum() + (lg(size * prior) - lg(weights.sum(axis=1))).sum()
            return bound
        weights = new


def test_sweep_is_the_plain_inference(spark, monkeypatch):
    monkeypatch.setattr(topic_sweep, "TERMS", 15)
    monkeypatch.setattr(topic_sweep, "BLOCK", 3)
    monkeypatch.setattr(topic_sweep, "CLOSE", 0.0)
    texts = [["x", "y", "z", "w", "x"] if i % 2 else ["p", "q", "r", "x"] for i in range(12)] + [[], ["rare"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, words array<string>").repartition(3)
    got = {(r["n"], r["k"]): r for r in topic_sweep.sweep(df, "words", [1, 2, 3], [2, 3], max_iter=3).collect()}
    assert sorted(got) == [(n, k) for n in (1, 2, 3) for k in (2, 3)]
    for n in (1, 2):
        grams = [[" ".join(t[i : i + n]) for i in range(len(t) - n + 1)] for t in texts]
        total, per = Counter(g for t in grams for g in t), Counter(g for t in grams for g in set(t))
        words = sorted([g for g in total if per[g] >= 2], key=lambda g: (-total[g], g))
        weight = {g: np.log((len(texts) + 1) / (per[g] + 1)) for g in words}
        docs = [{words.index(g): c * weight[g] for g, c in Counter(t).items() if g in weight} for t in grams]
        docs = [d for d in docs if d]
        models = topic_sweep.Models([2, 3], len(words), 1)
        for k, at in ((2, 0), (3, 2)):
            want = plain_bound(docs, k, len(words), models.weights[at : at + k], 3, topic_sweep.UPDATES)
            assert got[n, k]["log_likelihood"] == pytest.approx(want, rel=1e-9)
            assert got[n, k]["log_perplexity"] == pytest.approx(-want / sum(sum(d.values()) for d in docs), rel=1e-9)
    assert topic_sweep.sweep(df.limit(0), "words", [1], [2], max_iter=2).count() == 0


def test_sweep_blocks(monkeypatch):
    """Texts of similar size are updated together, filled up to the same size, which changes nothing for any of them."""
    monkeypatch.setattr(topic_sweep, "TERMS", 300)
    monkeypatch.setattr(topic_sweep, "CLOSE", 0.0)
    rng, ks = np.random.default_rng(5), np.array([2, 3, 5])
    factors = rng.random((10, 400))
    texts = [(np.sort(rng.choice(400, n, replace=False)), rng.random(n) + 0.1) for n in rng.integers(1, 60, 90)] + [(np.arange(350), np.ones(350))]
    rows = pd.DataFrame({"n": 1, "words": [w for w, _ in texts], "weights": [c for _, c in texts]})
    made = [b for _, b in topic_sweep.blocks(iter([rows]), {1: factors}, ks)]
    assert sum(len(b.sizes) for b in made) == len(texts)
    assert all(b.word.size <= 300 or len(b.sizes) == 1 for b in made)
    assert sum(b.word.size for b in made) < 1.2 * sum(len(w) for w, _ in texts)
    got, want, bounds = np.zeros((400, 10)), np.zeros((400, 10)), []
    for own, sums in ((made, got), ([topic_sweep.Texts([w], [c], factors, ks) for w, c in texts], want)):
        for b in own:
            b.settle()
            b.add(sums)
        bounds.append(sum(b.bound() for b in own))
    assert got == pytest.approx(want, rel=1e-9)
    assert bounds[0] == pytest.approx(bounds[1], rel=1e-9)
    whole = [np.add.reduceat((got * factors.T), [0, 2, 5], axis=1).sum(axis=0), sum(c.sum() for _, c in texts)]
    assert whole[0] == pytest.approx(np.full(3, whole[1]))


def test_gamma_functions():
    x = np.array([0.05, 0.5, 1.0, 2.5, 7.0, 40.0, 1e4])
    assert topic_sweep.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)
    step = 1e-5
    slope = [(math.lgamma(v + step * v) - math.lgamma(v - step * v)) / (2 * step * v) for v in x]
    assert topic_sweep.digamma(x) == pytest.approx(slope, rel=1e-5, abs=1e-5)


def test_components(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=200)
    m = np.column_stack([base, 100 * base + rng.normal(size=200), rng.normal(size=200)])
    df = spark.createDataFrame([(i, Vectors.dense(r.tolist())) for i, r in enumerate(m)], ["id", "v"])
    out, share = components.components(df, "v", 2)
    got = out.orderBy("id").toPandas()
    s = m / m.std(axis=0, ddof=1)
    vals, vecs = np.linalg.eigh(np.cov(s.T))
    want = s @ vecs[:, -1]
    np.testing.assert_allclose(np.abs(got["pc1"]), np.abs(want), rtol=1e-6)
    assert share[0] == pytest.approx(vals[-1] / vals.sum())


def test_components_of_wide_sparse_rows(spark):
    """Ten thousand dimensions, in agreement with Spark's own on those that are used."""
    rng = np.random.default_rng(4)
    rows, dense = [], []
    for i in range(300):
        kind = i % 3
        places = np.unique(np.append(rng.choice(40, 6) + 40 * kind, rng.choice(120, 2)))
        values = rng.integers(1, 5, len(places)).astype(float)
        rows.append((i, Vectors.sparse(10_000, (places * 83).tolist(), values.tolist())))
        line = np.zeros(120)
        line[places] = values
        dense.append((i, Vectors.dense(line.tolist())))
    wide, short = spark.createDataFrame(rows, ["id", "v"]).repartition(4), spark.createDataFrame(dense, ["id", "v"])
    got, share = components.components(wide, "v", 2)
    scaled = StandardScaler(inputCol="v", outputCol="s").fit(short).transform(short)
    model = PCA(k=2, inputCol="s", outputCol="p").fit(scaled)
    want = np.array([r["p"].toArray() for r in model.transform(scaled).orderBy("id").collect()])
    mine = got.orderBy("id").toPandas()
    for j, c in enumerate(("pc1", "pc2")):
        np.testing.assert_allclose(np.abs(mine[c]), np.abs(want[:, j]), atol=1e-6)
    np.testing.assert_allclose(share, model.explainedVariance.toArray(), atol=1e-8)


def test_components_of_odd_tables(spark):
    flat = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0])), (2, Vectors.dense([1.0, 2.0])), (3, None)], StructType([StructField("id", IntegerType()), StructField("v", VectorUDT())]))
    out, share = components.components(flat, "v", 2)
    assert share == [0.0, 0.0] and {r["id"]: r["pc1"] for r in out.collect()}[3] is None
    one, _ = components.components(flat.filter("id = 1"), "v", 2)
    assert one.count() == 1
    none, share = components.components(flat.limit(0), "v", 2)
    assert none.collect() == [] and none.columns == ["id", "v", "pc1", "pc2"]


def test_weighted_scores_and_tails(spark):
    df = spark.createDataFrame([(i, [0.5, 0.5], 0.0 if i else -10.0) for i in range(20)], "id int, w array<double>, s double")
    long = topics.weighted_scores(df, "w", "s", "id")
    assert long.count() == 40
    assert sorted(tuple(r) for r in topics.tails(long, "topic", "weighted").select("id", "topic", "tail").collect()) == [(0, 0, "negative"), (0, 1, "negative")]


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=2)
        k = "p" if i % 2 else "q"
        rows.append((i, k, float(a), float(b), float((3 if k == "p" else -1) * a + 2 * b + 5 + 0.01 * rng.normal())))
    return spark.createDataFrame(rows, "id int, code string, a double, b double, label double").cache()


def test_linear_per_key(linear):
    got = {(r["code"], r["term"]): r["coef"] for r in regression.linear_per_key(linear, "code", "label", ["a", "b"]).collect()}
    assert got["p", "a"] == pytest.approx(3, abs=0.01) and got["q", "a"] == pytest.approx(-1, abs=0.01)
    assert got["q", "const"] == pytest.approx(5, abs=0.01)


def test_split_is_stable(linear):
    mark = regression.in_training(["id"])
    a = {r["id"] for r in linear.filter(mark).collect()}
    b = {r["id"] for r in linear.repartition(7).filter(mark).collect()}
    assert a == b and 0.7 < len(a) / 400 < 0.9


def test_compare(linear):
    got = {(r["code"], r["family"]): r for r in regression.compare(linear, "code", ["a", "b"], ["linear", "tree"], ["id"]).collect()}
    assert len(got) == 4
    assert got["p", "linear"]["r2"] > 0.99 > got["p", "tree"]["r2"] > 0.5
    empty = linear.filter("false")
    assert regression.compare(empty, "code", ["a", "b"], regression.FAMILIES, ["id"]).count() == 0


def test_models_by_name(linear, spark):
    data = regression.assembled(linear, ["a", "b"]).select("label", "features")
    root = scratch_path(spark, "m")
    model = LinearRegression().fit(data)
    path = save_model(model, root, "linear", code=7)
    assert path == model_path(root, "linear", code=7)
    again = load_model(root, "linear", code=7)
    np.testing.assert_allclose(again.coefficients, model.coefficients)
    with pytest.raises(ValueError):
        model_path(root, "linearRegression", code=7)
    with pytest.raises(TypeError):
        save_model(model, root, "tree", code=7)


def test_wide_join_equals_chain(spark):
    counts = [(h, a, float(h * 10 + a)) for h in range(6) for a in (1, 2, 3) if (h, a) != (4, 2)]
    df = spark.createDataFrame(counts, "ts int, cluster int, count double")
    weather = spark.createDataFrame([(h, 20.0 + h) for h in (0, 1, 2, 4, 5)], "ts int, temperature double")
    labels = spark.createDataFrame([("p", h, 1.0) for h in range(6)], "code string, ts int, label double")
    got = regression.feature_frame(labels, regression.wide_counts(df, "ts", "cluster", "count", [1, 2, 3]), weather)
    chain = labels
    for a in (1, 2, 3):
        chain = chain.join(df.filter(F.col("cluster") == a).select("ts", F.col("count").alias(f"count_{a}")), "ts")
    chain = chain.join(weather, "ts")
    assert sorted(map(tuple, got.select(chain.columns).collect())) == sorted(map(tuple, chain.collect()))
    assert {r["ts"] for r in got.collect()} == {0, 1, 2, 5}


def test_small_side_checks(spark):
    big = spark.range(100)
    hinted = small_side(big, 1000)._jdf.queryExecution().analyzed().toString()
    plain = small_side(big, 10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()
