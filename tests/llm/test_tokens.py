"""Token counts and byte-level BPE against the libraries, over edge cases and any chunk sizes."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from helpers import EDGE, SF, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.queries import QUERIES
from millrace.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_counts_match_the_library_on_edge_cases(spark, tokenizer):
    got = map(tuple, count_tokens(documents(spark, EDGE)).collect())
    want = [(k, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in EDGE]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_counts_of_a_whole_table(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_token_counts"](spark, SF).collect():
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_counts_by_a_file_with_a_normaliser(spark):
    """Words of this file are lower-cased, composed and end with a mark of their own."""
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*EDGE, (40, "cafe\u0301 na\u0308ive"), (41, "ÉCOLE <|startoftext|>It's 12345!!"), (42, "a\u3000b ﬁne \u1e9b\u0323")]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = map(tuple, count_tokens(documents(spark, rows), vocab="word_bpe_49k.json").collect())
    want = [(k, len((t or "").encode()), len(other.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_files_of_other_libraries_are_refused(spark):
    with pytest.raises(ValueError, match="no tokenizers file"):
        count_tokens(documents(spark, EDGE), vocab="piece_bpe_32k.model")


def test_counts_with_few_buckets_and_an_empty_table(spark, tokenizer):
    docs = documents(spark, [(i, prose(i % 3) + " the the the") for i in range(60)])
    by_id = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, buckets=2).collect()}
    assert by_id == {i: len(tokenizer.encode(prose(i % 3) + " the the the", add_special_tokens=False).ids) for i in range(60)}
    assert count_tokens(docs.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1024), (50, 8), (64, 64), (17, 2)])
def test_encoding_is_the_same_for_any_chunks(spark, ranks, chunk, overlap):
    got = bpe.encode(documents(spark, EDGE), chunk_chars=chunk, overlap_chars=overlap).collect()
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted((repr(k), ranks.encode_ordinary(t or "")) for k, t in EDGE)


def test_decoding_gives_the_bytes_back(spark):
    done = bpe.decode(bpe.encode(documents(spark, EDGE))).collect()
    assert sorted((repr(r["doc_id"]), bytes(r["decoded"])) for r in done) == sorted((repr(k), (t or "").encode()) for k, t in EDGE)
    assert bpe.decode(bpe.encode(documents(spark, EDGE).filter("doc_id < 0"))).count() == 0


def test_query_digests(spark, ranks):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_bpe_round_trip"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ranks.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1\n\t'st.é漢  !"), max_size=80), st.integers(5, 20), st.integers(1, 12))
def test_stitching_meets_the_whole_split(text, size, overlap):
    import numpy as np
    import regex

    def split(s):
        found = regex.findall(bpe.PATTERN, s)
        return np.array(list(map(len, found)), np.int64), np.ones(len(found), np.int64), np.array([hash(p) % 1000 for p in found], np.int64)

    chunks = []
    for start in range(0, max(1, len(text)), size):
        part = text[start : start + size + overlap]
        sizes, counts, ids = split(part)
        chunks.append({"start": start, "text": part, "last": start + size >= len(text), "sizes": sizes, "counts": counts, "ids": ids})
    assert bpe.stitch_chunks(chunks, split).tolist() == split(text)[2].tolist()
