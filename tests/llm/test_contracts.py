"""The registered queries against plain versions over the whole small tables."""

import base64
import hashlib
import zlib

import brute
import pytest
from oracle_harness import compare

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]


def rows(spark, name, folder=SMALL):
    return [r.asDict() for r in entry.queries()[name](spark, folder).collect()]


def check_packing(found, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d: e.ids + [0] for (d, *_), e in zip(docs, known.encode_batch([t or "" for _, t, *_ in docs], add_special_tokens=False))}
    places: dict = {}
    for r in found:
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == brute.tokens_crc(own[r["start"] : r["start"] + r["length"]])
        head = len(own) % 2048 or 2048
        assert r["start"] == (0 if r["piece"] == 0 else head + 2048 * (r["piece"] - 1))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), -(-sum(map(len, ids.values())) // 2048)


def test_op1(spark, docs):
    used, least = check_packing(rows(spark, "op1_packing"), docs)
    assert used <= least * 1.05 + 1


def test_op2(spark):
    found = rows(spark, "op2_language", "/root/testdata/sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_op3(spark):
    pages = sorted((r["page_id"], r["html"] or "") for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect())
    first, want = {}, []
    for page, html in pages:
        raw = html.encode()
        one = first.setdefault(raw, page)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((page, len(raw), digest, "response" if one == page else "revisit", None if one == page else one))
    got = rows(spark, "op3_warc")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(tuple(r[n] for n in names) for r in got) == want


def test_op4(spark, docs):
    text = {d: t for d, t, _ in docs}
    for r in rows(spark, "op4_personal"):
        want = brute.personal(text[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[:5]
        assert set(want[5].split(",")) <= set(r["spans"].split(","))


def test_op5(spark, docs):
    text = {d: t for d, t, _ in docs}
    for r in rows(spark, "op5_secrets"):
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(text[r["doc_id"]])


def test_op6(spark, docs):
    want = brute.repeats([(d, t) for d, t, _ in docs])
    for r in rows(spark, "op6_repeats"):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_op7(spark, docs):
    want = brute.near([(d, t) for d, t, _ in docs])
    for r in rows(spark, "op7_minhash"):
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_op8(spark):
    name = "op8_decontamination"
    n, faults = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert n and not faults


def test_op9(spark, docs):
    text = {d: t for d, t, _ in docs}
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    for r in rows(spark, "op9_quality"):
        assert tuple(r[n] for n in names) == brute.quality(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_op9_kept(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want = brute.quality_kept([tuple(r) for r in table])
    got = {r["doc_id"]: r["kept"] for r in rows(spark, "op9_quality", folder)}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_op10(spark, docs):
    text = {d: t for d, t, _ in docs}
    for r in rows(spark, "op10_licenses"):
        assert tuple(r[n] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute.phrases(text[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_pipeline(spark, docs):
    """Stage by stage in plain Python: near duplicates, leaks and masks decide what is packed."""
    bench = [brute.shingle_set(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = [(d, t) for d, t, _ in docs if any(c.isalpha() for c in t or "")]
    near = brute.near(left)
    left = [(d, t) for d, t in left if near[d][1] == d]
    hit = lambda t: any(100 * len(b & s) >= 75 * len(b) for s in [brute.shingle_set(t)] for b in bench if b)
    left = [(d, t) for d, t in left if not hit(t)]
    out = []
    for d, t in left:
        at, new = 0, ""
        for x in filter(None, brute.personal(t)[5].split(",")):
            kind, a, b = x.split(":")
            if int(a) >= at:
                new += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        out.append((d, new + t[at:], None))
    found = rows(spark, "pipeline")
    assert {r["doc_id"] for r in found} == {d for d, *_ in out}
    check_packing(found, out)
