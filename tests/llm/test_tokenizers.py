import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricebench.llm import byte_bpe, packing, token_counts
from pricebench.llm.perfect_hash import PerfectHash

PATH = public_tokenizers.path(byte_bpe.TIKTOKEN_FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
WORDS = Tokenizer.from_file(public_tokenizers.path(token_counts.WORD_FILE))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys_and_comes_back(text):
    enc = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    assert enc.encode(text) == packed(LIBRARY.encode_ordinary(text))
    own = packing._encoder(PATH)
    for t in (text, text + "<|endoftext|>x", text + "long" * 200 + text, text + " \n" * 300 + text):
        want = packed(BYTES.encode(t, add_special_tokens=False).ids)
        assert own.encode(t) == packing._encoder(PATH, alike=False).encode(t) == want


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_librarys(text):
    bpe = token_counts.word_bpe(public_tokenizers.path(token_counts.WORD_FILE))
    counts = token_counts.Counts(bpe, token_counts.proven_words(public_tokenizers.path(token_counts.WORD_FILE)))
    for t in (text, f"A<|startoftext|>{text}<|ENDOFTEXT|>"):
        assert counts.of(t) == len(WORDS.encode(t, add_special_tokens=False).ids)


def test_every_code_point_is_cut_and_lowered_as_the_libraries_do():
    """op3, op4 and op6 on code points between letters, digits, marks and spaces; of ideographs, syllables and empty planes every 64th."""
    enc, own = byte_bpe.encoder(PATH, public_tokenizers.PATTERN), packing._encoder(PATH)
    apart = packing._encoder(PATH, alike=False)
    bpe = token_counts.word_bpe(public_tokenizers.path(token_counts.WORD_FILE))
    counts = token_counts.Counts(bpe, token_counts.proven_words(public_tokenizers.path(token_counts.WORD_FILE)))
    alike = [(0x3400, 0xA000), (0xAC00, 0xD800), (0xE000, 0xF900), (0x17000, 0x19000), (0x20000, 0xE0000), (0xE0200, 0x110000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c % 64 == 0 or not any(a <= c < b for a, b in alike))]
    for context in ("a{0}b", "1{0} {0}", "漢{0}\u0323\u0334{0}"):
        for i in range(0, len(points), 5003):
            part = points[i : i + 5003]
            text = "\n".join(context.format(c) for c in part)
            cases = [(enc.encode, LIBRARY.encode_ordinary, packed), (own.encode, lambda t: BYTES.encode(t, add_special_tokens=False).ids, packed),
                     (apart.encode, LIBRARY.encode_ordinary, packed),
                     (counts.of, lambda t: WORDS.encode(t, add_special_tokens=False).ids, len)]
            for got, want, form in cases:
                if got(text) != form(want(text)):
                    bad = [hex(ord(c)) for c in part if got(context.format(c)) != form(want(context.format(c)))]
                    raise AssertionError((context, got, bad[:20]))


def test_proof_holds_against_the_library():
    words = list(token_counts.proven_words(public_tokenizers.path(token_counts.WORD_FILE)))[::97]
    bpe = token_counts.word_bpe(public_tokenizers.path(token_counts.WORD_FILE))
    for w in words:
        if bpe.split(bpe.normal(w)) == [w]:
            assert len(WORDS.encode(w, add_special_tokens=False).ids) == 1


def test_perfect_hash_is_minimal_and_exact():
    keys = {f"k{i}".encode(): i for i in range(5000)}
    table = PerfectHash(keys)
    assert len(table.keys) == 5000 and all(table.get(k) == v for k, v in keys.items())
    assert table.get(b"k5000") is None and PerfectHash({}).get(b"x") is None


def test_encode_and_decode_of_odd_documents(odd_docs, no_docs):
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(odd_docs)).collect()
    assert len(out) == odd_docs.count() and out[0]["kept"] == "clash"
    for r in out:
        assert r["ids"] == packed(LIBRARY.encode_ordinary(r["text"] or ""))
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode_texts(no_docs).count() == 0


def test_counts_of_odd_documents(odd_docs, no_docs):
    for r in token_counts.count_tokens(odd_docs).select("text", "n_tokens").collect():
        assert r["n_tokens"] == len(WORDS.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(no_docs).count() == 0


def check_packing(rows, texts, window):
    """``texts``: list of the documents' texts; repeated ids are allowed."""
    want = defaultdict(int)
    for t in texts:
        want[packed([*BYTES.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    assert sum(r["length"] for r in rows) * 4 == sum(len(k) * n for k, n in want.items())
    return want


@pytest.mark.parametrize("lane", [1 << 20, 5000])
def test_packing_of_odd_documents(odd_docs, no_docs, lane):
    rows = packing.pack(odd_docs, lane_tokens=lane).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    check_packing(rows, texts, packing.WINDOW)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc, text in {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] not in (2,)}.items():
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        joined = b"".join(bytes(p["ids"]) for p in pieces)
        assert joined == packed([*BYTES.encode(text or "", add_special_tokens=False).ids, 1])
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
    assert packing.pack(no_docs).count() == 0


def test_every_window_has_the_wanted_mixture(spark):
    rows = [(i, f"s{i % 10 // 6 + (i % 10 == 9)}", "word " * (20 + i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = packing.pack(docs, lane_tokens=20_000)
    total = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    whole = sum(total.values())
    last = {}
    for r in out.where("sequence_id < 4294967296").orderBy("sequence_id", "offset").collect():
        last.setdefault(r["sequence_id"], defaultdict(int))[r["source"]] += r["length"]
    served, size = defaultdict(int), 0
    full = [w for _, w in sorted(last.items()) if sum(w.values()) == packing.WINDOW]
    assert len(full) > 4
    for w in full:
        size += packing.WINDOW
        for s, n in w.items():
            served[s] += n
        # Carried deficits never grow beyond a quantum and what a document in service may add.
        assert all(abs(served[s] - size * total[s] / whole) <= 2 * packing.QUANTUM for s in total)


def test_documents_longer_than_their_share_of_a_lane_are_cut(spark):
    lane, quantum = 16_384, 64
    rows = [(i, "a", "word " * 500) for i in range(400)] + [(1000, "b", "word " * 4000), (1001, "c", "word " * 30)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string"), window=512, quantum=quantum, lane_tokens=lane).collect()
    total, by_lane, pieces = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for r in out:
        total[r["source"]] += r["length"]
        by_lane[r["sequence_id"] >> 32][r["source"]] += r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    whole = sum(total.values())
    assert len({r["sequence_id"] >> 32 for r in out if r["doc_id"] == 1000}) > 5
    for n in [by_lane[k] for k in sorted(by_lane)][:-1]:
        assert all(abs(n[s] - lane * total[s] / whole) <= quantum for s in total)
    for parts in pieces.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == parts[0][2]


def test_given_weights_decide_while_queues_last(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "word " * 40) for i in range(2000)], "doc_id long, source string, text string")
    out = packing.pack(docs, weights={"s0": 3.0, "s1": 1.0}, lane_tokens=16_384)
    first = out.where("sequence_id < 4294967296").groupBy("source").agg(F.sum("length").alias("n")).collect()
    n = {r["source"]: r["n"] for r in first}
    assert 2.5 < n["s0"] / n["s1"] < 3.5


def test_queries_digest_what_the_operators_give(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in byte_bpe.op3_byte_bpe(spark, sf_dir).collect():
        ids = packed(LIBRARY.encode_ordinary(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    for r in token_counts.op4_token_counts(spark, sf_dir).collect():
        n = len(WORDS.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)
    for r in packing.op6_packing(spark, sf_dir).collect():
        ids = np.array([*BYTES.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
