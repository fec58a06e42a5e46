"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and each method's own part."""

import base64
import json
import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, decontaminate, langid, licenses, links, minhash, packing, pii, quality, repeats, secrets, warc
from tallyloom.llm.queries import vocabulary

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, h bigint, tag string, row int, label string, kept int"
SAME = "one two three four five six seven eight nine ten " * 6


def odd_rows():
    texts = [None, "", " \n\t", "a", "Ünï 漢字", LONG, SAME, SAME, "a b c d", "\x00\x01", "12 34", "x" * 50_000]
    out = [(i, t, "en" if i % 2 else None, None, 0, 1, 2, "t", 3, "l", 4) for i, t in enumerate(texts)]
    return [*out, out[6], (None, SAME, "en", "s", 0, 1, 2, "t", 3, "l", 4), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


OPERATORS = {
    "packing": lambda d: packing.pack(d, vocabulary()),
    "langid": langid.label,
    "with_language": langid.with_language,
    "pii": pii.scan,
    "mask": pii.mask,
    "secrets": secrets.scan,
    "repeats": repeats.kept_texts,
    "minhash": minhash.near_duplicates,
    "quality": quality.judge,
    "licenses": licenses.scan,
    "decontaminate": lambda d: decontaminate.per_document(d, d.selectExpr("doc_id as item_id", "text")),
    "clean": lambda d: decontaminate.clean(d, d.selectExpr("doc_id as item_id", "text").limit(0)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    rows = OPERATORS[name](odd).collect()
    many = {"packing": None, "with_language": None}.get(name, len(odd_rows()))
    assert rows if many is None else len(rows) == many
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_odd_results(odd):
    near = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(odd).collect()}
    assert {(6, 6), (7, 6), (1, 1), (None, None)} <= near
    gone = {r["doc_id"]: sum(s["stop"] - s["start"] for s in r["spans"]) for r in repeats.kept_texts(odd).filter("doc_id is not null").collect()}
    want = brute.repeats([(r[0], r[1]) for r in odd_rows()[:12] if r[0] is not None] )
    assert gone[5] == want[5][1] and gone[11] == want[11][1]
    assert {r["lang_pred"] for r in langid.label(odd).filter("doc_id in (0, 1, 2)").collect()} == {"und"}


def test_warc_edges(spark):
    rows = [(3, "http://a.example.com/x", "hey"), (1, "http://a.example.com/x", "hey"), (2, None, None), (4, "bad url [", ""), (1, "http://a.example.com/x", "hey")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(1, 3, "response", None), (1, 3, "response", None), (2, 0, "response", None), (3, 3, "revisit", 1), (4, 0, "revisit", 2)]
    assert all(r["record_type"] == "response" for r in warc.round_trip(pages, min_payload=10).collect())
    assert warc.round_trip(pages.limit(0)).collect() == []
    assert warc.url_key("http://WWW.a.example.com:8080/x?y=1#z") == "com,example,a,www:8080)/x?y=1"


def test_index_lookup(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i}") for i in range(3000)], "page_id bigint, url string, html string")
    entries, files, folder = warc.archive(pages)
    keys = entries.filter("page % 97 = 0").select("urlkey", "page")
    found = warc.read(warc.lookup(keys, files, folder), folder).collect()
    assert sorted(r["page_id"] for r in found) == list(range(0, 3000, 97))


def test_packing_plans():
    draw = random.Random(5)
    for _ in range(20):
        counts = {draw.randint(1, 64): draw.randint(1, 40) for _ in range(draw.randint(1, 30))}
        plans = packing.plan(counts, 64)
        assert all(sum(p) <= 64 for p, _ in plans)
        used: dict = {}
        for p, times in plans:
            for x in p:
                used[x] = used.get(x, 0) + times
        assert used == counts
    assert packing.plan({60: 3, 4: 3}, 64) == [((60, 4), 3)]
    assert packing.plan({40: 2, 20: 2, 3: 2, 1: 2}, 64) == [((40, 20, 3, 1), 2)]


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "more words")], "doc_id bigint, text string")
    packed = packing.pack(docs, vocabulary(), 16, with_ids=True)
    one = packing.sequences(packed).collect()
    assert sum(r["length"] for r in one) == sum(len(packing.ids_array(r["ids"])) for r in one)


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in links.components(pairs).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0


def test_minhash_chains(spark):
    """Versions that drift: neighbours are linked, the ends are not; no star holds them all."""
    draw, words, rows = random.Random(3), [f"w{i}" for i in range(150)], []
    for i in range(60):
        words = list(words)
        words[draw.randrange(len(words))] = f"n{i}"
        rows.append((i, " ".join(words)))
    want = brute.near(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def wide_group(copies: int, seed: int) -> list[tuple[int, str]]:
    """Near copies of one text with changes of their own: like the text, often not like each other; and a few like a copy alone."""
    draw, words, rows = random.Random(seed), [f"w{i}" for i in range(200)], []
    for i in range(copies):
        own = list(words)
        for k in draw.sample(range(200), 7):
            own[k] = f"n{i}-{k}"
        rows.append((3 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((3 * i + 1, " ".join([*own[:-12], *[f"t{i}-{k}" for k in range(12)]])))
    return rows


@pytest.mark.parametrize("gain", [0.0, 0.75, 1.0])
def test_minhash_rounds(spark, monkeypatch, gain):
    """The same components whether rounds of centres or blocks find the last links."""
    monkeypatch.setattr(minhash, "GAIN", gain)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    rows = wide_group(120, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.near(rows)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    """A key with a third of all rows, null keys and keys that only one side has."""
    many = spark.createDataFrame([(None if i % 3 == 1 else 7 if i % 3 else i, i) for i in range(600)], "k bigint, i bigint")
    one = spark.createDataFrame([(k, k * 10) for k in range(0, 300)], "k bigint, v bigint")
    want = sorted(map(tuple, many.join(one, "k", how).collect()), key=str)
    for share in (2, 50):
        assert sorted(map(tuple, common.salted_join(many, one, "k", "i", how, share=share).select("k", "i", "v").collect()), key=str) == want
    assert common.salted_join(many.limit(0), one, "k", "i", how).collect() == []


def test_forest_links_what_is_similar():
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(10, 110), np.arange(500, 600)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    assert minhash.forest(np.arange(4), np.arange(4), starts, np.concatenate(sets)) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("hot", [1, 4096])
def test_repeats_both_ways(spark, hot):
    draw, passage = random.Random(8), "".join(random.Random(1).choice("abcdef ") for _ in range(400))
    rows = []
    for i in range(60):
        own = "".join(draw.choice("abcdefghij ") for _ in range(300))
        a, b = sorted((draw.randrange(400), draw.randrange(400)))
        rows.append((i, own + passage[a:b] + own[:150] + ("zz" * 90 if i % 5 == 0 else "") + "é" * (i % 3)))
    want = brute.repeats(rows)
    got = repeats.kept_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), hot=hot).collect()
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == want[r["doc_id"]][1], r["doc_id"]
        assert len(r["spans"]) == want[r["doc_id"]][2]


def test_learned_patterns(spark):
    rows = [(i, f"please call desk phone +1 (555) 555-{1000 + i} now") for i in range(40)]
    rows += [(100, "please call desk phone 5550199284 now"), (101, "an order of 5550199284 pieces")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == ["phone"] and got[101] == [] and got[3] == ["phone"]


def test_learned_shapes(spark):
    """Identifiers that the plain patterns run together are found by the shape of the others; numbers a test refuses are not."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("aeiourstln") for _ in range(draw.randint(2, 9)))
    rows = [(i, f"{word()} {word()} +1 ({200 + i}) 555-{1000 + 7 * i} {word()}") for i in range(40)]
    cards = []
    while len(cards) < 42:
        number = "4" + "".join(draw.choice("0123456789") for _ in range(15))
        cards += [number] if brute.luhn(number) else []
    rows += [(100 + i, f"{word()} {c} {word()}") for i, c in enumerate(cards[2:])]
    odd = {
        200: (f"ab +1 (311) 555-4321 {cards[0]} cd", "phone:3:20,card:21:37"),
        201: (f"ab {cards[0]} {cards[1]} cd", "card:3:19,card:20:36"),
        202: ("ab 4000000000000001 cd", ""),
        203: ("version 1.2.300.4 of 12345678 and 555-1234", ""),
        204: ("ab +1 (311) 555-4321 10.20.30.40 cd", "phone:3:20,ip:21:32"),
    }
    rows += [(i, t) for i, (t, _) in odd.items()]
    rows += [(300, "1 22 (333) 4444-55 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    told = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
    assert {i: told(got[i]["spans"]) for i in odd} == {i: s for i, (_, s) in odd.items()}
    assert all(told(got[i]["base"]) == brute.personal(t)[5] for i, t in rows)


def test_found_values_become_seeds(spark):
    """Values found by one context teach a second one, which holds no seed itself."""
    seeds = [(1000 + i, f"call desk phone +1 (555) 555-{1000 + i} now") for i in range(200)]
    found = [(100 + i, f"call desk phone 0{i:02d}9 284 5{i:02d} now") for i in range(40)]
    again = [(200 + i, f"reach nightly service 0{i:02d}9 284 5{i:02d} please") for i in range(40)]
    rows = [*seeds, *found, *again, (300, "reach nightly service 0777333111 please"), (301, "an order of 0777 333 222 pieces")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == ["phone"] and got[205] == ["phone"] and got[300] == ["phone"] and got[301] == []


def test_learned_patterns_without_long_tokens(spark):
    """Emails without a dot and digits in groups are reported where their contexts are sure, and only there."""
    rows = [(i, f"please call desk phone +1 (555) 555-{1000 + i} now") for i in range(40)]
    rows += [(50 + i, f"write to mail box user{chr(97 + i % 26)}{i}@site.example today") for i in range(40)]
    odd = {100: ("please call desk phone 0199 284 555 now", "phone"), 101: ("please call desk phone (0199) 284-555 now", "phone")}
    odd |= {102: ("write to mail box jane@intranet today", "email"), 103: ("an order of 0199 284 555 pieces", ""), 104: ("the mark jane@intranet stood there", "")}
    rows += [(i, t) for i, (t, _) in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: ",".join(s["kind"] for s in r["spans"]) for r in pii.scan(docs).collect()}
    assert {i: got[i] for i in odd} == {i: kind for i, (_, kind) in odd.items()}
    text = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert text[100] == "please call desk phone [PHONE] now" and text[102] == "write to mail box [EMAIL] today"


def test_long_runs_are_read_once():
    import time

    for run in ("a" * 1_000_000, "a1-_" * 250_000, "ab." * 200_000, "A+/" * 300_000, "0f" * 400_000, "x" * 12 + ".y" * 300_000):
        began = time.process_time()
        secrets.find(run)
        assert time.process_time() - began < 3, run[:10]


def test_structures():
    body = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = f"{body({'alg': 'HS256', 'typ': 'JWT'})}.{body({'sub': 'someone', 'n': 1})}.{'a' * 43}"
    number = b"\x02\x20" + bytes(range(1, 33))
    der = b"\x30" + bytes([len(number) * 2]) + number * 2
    key = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
    kinds = lambda t: [k for k, *_ in secrets.find(t) if k in ("der", "ssh", "token")]
    assert kinds("x " + token) == ["token"] and kinds("x " + token.replace("eyJ", "aaa", 1)) == []
    assert kinds(base64.b64encode(der).decode()) == ["der"] and kinds(der.hex()) == ["der"]
    assert kinds("ssh-ed25519 " + base64.b64encode(key).decode()) == ["ssh"]
    assert kinds(base64.b64encode(der[:-1]).decode()) == [] and kinds("A" * 80) == []


def test_structures_behind_names():
    number = b"\x02\x20" + bytes(range(1, 33))
    der = b"\x30" + bytes([len(number) * 2 + 4]) + number * 2 + b"\x04\x02ab"
    key = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
    plain, ssh = base64.b64encode(der).decode(), base64.b64encode(key).decode()
    assert plain.endswith("=")
    names = ["SIGNING_KEY=", "cert=", "A_NAME_AS_LONG_AS_A_CANDIDATE_IS=", "some-prefix-", "x0=="]
    for name in names:
        for kind, body in (("der", plain), ("ssh", ssh)):
            text = f"set {name}{body} and on"
            found = [x for x in secrets.find(text) if x[0] in ("der", "ssh")]
            assert found == [(kind, text.index(body), text.index(body) + len(body))], (name, kind)
    for body in (der.hex(), der.hex().upper()):
        assert ("der", 2, 2 + len(body)) in secrets.find("0x" + body)
    # one report of a stretch that several patterns see
    assert [k for k, *_ in secrets.find(plain) if k == "der"] == ["der"]


def test_license_islands(spark):
    text = dict((b, a) for a, b in licenses.TEMPLATES)["isc"].split()
    edited = " ".join(text[:9] + ["really"] + text[9:])
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(1, edited), (2, " ".join(text[:5]))], "doc_id bigint, text string")).collect()}
    assert got == {1: "isc", 2: ""}


def test_licenses_by_their_telling_words(spark):
    gnu, cc = "Licensed under the GNU {}General Public License, version {}.", "Licensed under a Creative Commons Attribution{} 4.0 International License."
    redistribute = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    texts = {
        gnu.format("", "3"): "gpl-3", gnu.format("", "2"): "gpl-2", gnu.format("", "1"): "", gnu.format("Lesser ", "3"): "lgpl-3", gnu.format("Affero ", "3"): "agpl-3",
        cc.format(""): "cc-by", cc.format("-NonCommercial"): "cc-by-nc", cc.format("-ShareAlike"): "cc-by-sa", cc.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        redistribute.format(""): "gpl", redistribute.format("Lesser "): "lgpl", redistribute.format("Affero "): "agpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts.values())
    own = licenses.scan(spark.createDataFrame([(1, "you may use our words for one year only"), (2, "you may use our words for two year only")], "doc_id bigint, text string"),
                        templates=[("you may use our words for one year only", "ours")], telling={"ours": ["for one year"]})
    assert {r["doc_id"]: r["labels"] for r in own.collect()} == {1: "ours", 2: ""}


def test_containment_in_long_texts(spark):
    item = [f"q{i}" for i in range(60)]
    rows = [(1, LONG + " " + " ".join(item) + " " + LONG), (2, LONG), (3, " ".join(item[:50])), (4, " ".join(item[:30]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item))], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 9), (3, 9)]


def test_thresholds_follow_groups(spark):
    rows = [(i, "plain words only here again " * 8 + f"{i} extra", "en", "a") for i in range(5)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert all(r["base_failed"] for r in out)


def test_thresholds_come_from_the_group(spark):
    """The same text is an outlier of a group of even texts and none of a group of uneven ones."""
    draw = random.Random(4)

    def text(capitals, symbols=0):
        words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in draw.sample(range(676), 100)]
        words[:capitals] = [w.upper() for w in words[:capitals]]
        return " ".join(words + ["#"] * symbols)

    rows = [(i, text(1 + i % 2), "en", "even") for i in range(300)] + [(1000 + i, text(i % 21), "en", "uneven") for i in range(300)]
    mid, bad = text(25), text(1, symbols=30)
    rows += [(5000, mid, "en", "even"), (5001, mid, "en", "uneven"), (5002, bad, "en", "even"), (5003, bad, "en", "uneven")]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not out[5000]["kept"] and out[5001]["kept"]
    assert not out[5002]["kept"] and not out[5003]["kept"]
    assert all(out[i]["kept"] for i in [*range(300), *range(1000, 1300)])
    # single events are no evidence: one repeated line among even texts stays
    lines = "\n".join(text(1) for _ in range(4))
    rows.append((5004, lines + "\n" + "a b c\n" * 2, "en", "even"))
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert out[5004]["kept"]


def test_small_languages_keep_their_words(spark):
    """A language with most rows takes neither the sample nor the table of one with few."""
    rows = [(i, " ".join(f"big{chr(97 + j)}{chr(97 + i % 26)}" for j in range(20)), "big") for i in range(2000)]
    rows += [(5000 + i, "tiny words here", "small") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs, max_rows=100, features=50)
    assert model["langs"] == ["big", "small"]
    found = langid.Letters(["tiny words here"], langid.letter_table())
    assert model["tables"][0].find(found.hashes(found.start, found.end))[1].all()
    assert 50 <= len(model["tables"][0][0]) <= 100
    assert langid.shares({"a": 2, "b": 1000, "c": 50}, 100) == {"a": 2, "c": 49, "b": 49}


def test_feature_counts_are_those_of_all_words(spark):
    """Distinct words are cut once, and their runs count as often as the words (brute force)."""
    from collections import Counter

    texts = [(1, "ab ab abc", "x"), (2, "ab Ab cde", "x"), (3, "ab zz, zz", "y"), (4, "", "y"), (5, None, "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    want = Counter()
    for _, text, lang in texts:
        for word in (text or "").lower().replace(",", " ").split():
            want[0, word, lang] += 1
            for n in range(1, langid.LONGEST + 1):
                for i in range(len(word) - n + 1):
                    want[n, word[i : i + n], lang] += 1
    found = langid.feature_counts(docs).collect()
    assert sorted((r["size"], r["lang"], r["n"]) for r in found) == sorted((k, lang, n) for (k, _, lang), n in want.items())


def test_model_of_many_languages(spark):
    """A hundred languages: nearly all held-out texts right, and a model of a few bytes for each feature a language has."""
    draw = random.Random(12)
    rows = []
    for lang in range(100):
        syllables = ["".join(draw.choice("abcdefghijklmnoprstuvzäéñøş") for _ in range(draw.randint(2, 3))) for _ in range(25)]
        for _ in range(30):
            words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(40)]
            rows.append((len(rows), " ".join(words), f"l{lang:02d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs.filter("doc_id % 5 <> 0"))
    features = {(lang, size, x) for i, text, lang in rows if i % 5 for w in text.split() for size in range(5)
                for x in ([w] if not size else [w[j : j + size] for j in range(len(w) - size + 1)])}
    size = sum(t.nbytes() for t in model["tables"])
    assert sum(len(t.lang) for t in model["tables"]) == len(features)
    assert size <= 24 * len(features) + 10_000
    right = {i: lang for i, _, lang in rows}
    held = langid.predict(docs.filter("doc_id % 5 = 0").select("doc_id", "text"), model).collect()
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in held) >= 0.99 * len(held)


def test_sparse_scores_are_the_dense_ones(spark):
    draw = random.Random(13)
    rows = [(i, " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(12)), f"l{i % 3}") for i in range(60)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    count = [{f"l{k}": {} for k in range(3)} for _ in range(5)]
    for _, text, lang in rows:
        for w in text.split():
            for size in range(5):
                for x in [w] if not size else [w[j : j + size] for j in range(len(w) - size + 1)]:
                    count[size][lang][x] = count[size][lang].get(x, 0) + 1

    def log(size, lang, x):
        every = set().union(*count[size].values())
        own = count[size][lang]
        return np.log((own.get(x, 0) + 0.5) / (sum(own.values()) + 0.5 * len(every)))

    words = ["abc", "é", "zzz", "abcdzab", "ccccccc", "bzzzb"]
    found = langid.Letters([" ".join(words)], langid.letter_table())
    got = langid.word_scores(found, model, np.arange(len(words)))
    for w, line in zip(words, got, strict=True):
        for k, lang in enumerate(model["langs"]):
            want = 0.0
            for size in (0, 4, 3, 2, 1):
                runs = [w] if not size else [w[j : j + size] for j in range(len(w) - size + 1)]
                known = [x for x in runs if any(x in count[size][m] for m in model["langs"])]
                if known:
                    want = sum(log(size, lang, x) for x in known) / len(known)
                    break
            assert abs(line[k] - want) < 1e-5, (w, lang)


def test_marked_rows(spark, monkeypatch):
    # no key is lost, and nearly all other rows go, unless the filter is too small for its keys
    many = spark.range(-5000, 20000).select(F.col("id").alias("k"), F.lit("x").alias("wide"))
    many = many.unionByName(spark.createDataFrame([(None, "null")], "k bigint, wide string"))
    for step in (7, 4000, 10**6):
        wanted = set(range(-step, 20000, step))
        keys = spark.createDataFrame([(k,) for k in wanted] + [(None,)], "k bigint")
        got = {r["k"] for r in common.marked(many, "k", keys).collect()}
        assert wanted & set(range(-5000, 20000)) <= got and None not in got
        assert len(got - wanted) <= 0.05 * 25000
    monkeypatch.setattr(common, "FILTER_LONGS", 16)
    keys = spark.range(0, 20000, 7).select(F.col("id").alias("k"))
    assert common.marked(many, "k", keys).join(keys, "k").count() == keys.count()
    assert common.marked(many, "k", keys.filter("k < 0")).count() == 0


def test_minhash_shuffles_few_unneeded_texts(spark, monkeypatch):
    # texts that no candidate pair and no block names stay where they are, however many pairs there are
    docs = spark.createDataFrame([(i, f"{i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(2000)], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2, 1, 2), (3, 4, 3, 4)], "a bigint, b bigint, doc_a bigint, doc_b bigint")
    classes = spark.createDataFrame([(i, i) for i in range(2000)], "set_key bigint, doc_id bigint")
    left, old = [], common.marked
    for module in (common, minhash):
        monkeypatch.setattr(module, "marked", lambda *args: left.append(old(*args)) or left[-1])
    minhash.confirmed(pairs, docs)
    minhash.full_sets(spark.createDataFrame([(5,), (6,)], "set_key bigint"), classes, docs)
    assert len(left) == 3 and all(2 <= rows.count() <= 200 for rows in left)


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_marked_counts_its_keys_once(spark, monkeypatch, few):
    # by a filter and by the keys themselves; a job for each doubling of the filter filled the driver's memory
    monkeypatch.setattr(common, "FEW_KEYS", few, raising=False)
    counted, kind = [], type(spark.range(0))
    old = kind.count
    monkeypatch.setattr(kind, "count", lambda self: counted.append(1) or old(self))
    many = spark.range(-5000, 20000).select(F.lit("x").alias("wide"), F.col("id").alias("k"))
    keys = spark.range(0, 20000, 5).select(F.col("id").alias("k"))
    rows = common.marked(many, "k", keys)
    assert len(counted) == 1 and rows.columns == many.columns
    got = {r["k"] for r in rows.collect()}
    assert set(range(0, 20000, 5)) <= got and len(got) <= 5000 and (not few or len(got) == 4000)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_without_hot_keys(spark, monkeypatch, how):
    # no table of hot keys is written or broadcast for none, and null keys are dealt out all the same
    many = spark.createDataFrame([(i if i % 2 else None, i) for i in range(8000)], "k bigint, i bigint")
    one = spark.createDataFrame([(k, k * 10) for k in range(0, 6000)], "k bigint, v bigint")
    want = sorted(map(tuple, many.join(one, "k", how).collect()), key=str)
    monkeypatch.setattr(common, "keep", lambda df, label: pytest.fail(label))
    sizes = many.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    joined = common.salted_join(many, one, "k", "i", how, sizes=sizes)
    assert sorted(map(tuple, joined.collect()), key=str) == want
    monkeypatch.undo()
    parts, held = spark.conf.get("spark.sql.shuffle.partitions"), {}
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        held[name] = spark.conf.get(name)
        spark.conf.set(name, value)
    try:
        sizes = [r["count"] for r in joined.select("i").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    assert max(sizes) < 2 * sum(sizes) / int(parts)


def test_no_blocks_are_cut_for_no_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "block_links", lambda *args: pytest.fail("nothing is left to compare"))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, f"{words} x"), (3, "some other words"), (4, words)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_language_counts_in_small_parts(spark):
    """A worker's memory follows a part of its batch, not all of it."""

    class Taken:
        def mapInArrow(self, work, schema):  # noqa: N802
            self.work = work
            return self

        select = groupBy = agg = lambda self, *args: self  # noqa: N815

    taken = Taken()
    langid.feature_counts(taken)
    texts = [" ".join(f"word{i % 50}" for i in range(k, k + 400)) for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], ["text", "lang"])
    tracemalloc.start()
    try:
        total = sum(sum(x.column(3).to_pylist()) for x in taken.work(iter([batch])) if x.column(1)[0].as_py() == 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 400 * 2000
    assert peak < 80 << 20, peak
