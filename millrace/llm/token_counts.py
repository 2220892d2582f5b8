"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to document frequencies.

No id is ever materialised. A plain (document, pre-token, frequency) table has a row for nearly every word of the
corpus, so frequencies travel packed: a block of documents sends, for each bucket of pre-tokens, one row with its
distinct pre-tokens and their (document, frequency) postings. The bucket's task counts the pieces of each distinct
pre-token once and joins; the block's task sums. There are as many buckets as the texts are large, a task goes through
its buckets one by one, and a very common pre-token is one entry a block, so no bucket is hot and none is held whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, from_ipc, pack, shuffle_partitions, to_ipc, unpack, vocabulary
from millrace.ship import ship

#: A bucket gets the pre-tokens of about so many bytes of text.
BUCKET_BYTES = 8_000_000
#: Fixed value: the published splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The library's Unicode tables are older than the regex module's. They agree on these characters; a text with any other is split by the library.
AGREED = re.compile("[^\x00-՗‐-₀₠-鿿가-힣]")


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """The tokenizer of a file, read once in a worker's life. It starts no threads of its own, as each core has a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of a text as the tokenizer file splits it, and their numbers of pieces.

    Files of plain byte-level BPE have the published pattern; those with a normaliser or another splitting are asked
    for both. Files whose special strings depend on their surroundings are refused, as are those of other libraries.
    """

    def __init__(self, path: str) -> None:
        if not path.endswith(".json"):
            raise ValueError(f"{path} is no tokenizers file (.json)")
        self.tokenizer = tokenizer_of(path)
        own = json.loads(self.tokenizer.to_str())
        if own["model"].get("dropout") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in own["added_tokens"]):
            raise ValueError(f"{path} has tokens that cannot be counted apart from their surroundings")
        split = own["pre_tokenizer"] or {}
        self.plain = own["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        specials = sorted((t["content"] for t in own["added_tokens"]), key=len, reverse=True)
        self.apart = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.find = regex.compile(PATTERN).findall

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand between them."""
        parts = self.apart.split(text) if self.apart else [text]
        return self._words(parts[0]) if len(parts) == 1 else [w for p in parts for w in self._words(p)], len(parts) - 1

    def _words(self, text: str) -> list[str]:
        if self.plain and not AGREED.search(text):
            return self.find(text)
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        if not self.tokenizer.pre_tokenizer:
            return [normal] if normal else []
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [text[a:b] for _, (a, b) in found] if self.plain else [w for w, _ in found]

    def pieces(self, words: list[str]) -> list[int]:
        if self.plain:
            return [len(x) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [len(self.tokenizer.model.tokenize(w)) for w in words]


@lru_cache(maxsize=2)
def splitter_of(path: str) -> Splitter:
    return Splitter(path)


def _send(path: str, buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(path)
        for block, ids, texts in blocks(batches):
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            tokens, extra = [], []
            for text in texts:
                words, specials = splitter.words(text)
                tokens.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                extra.append(specials)
            n_bytes = [len(t.encode()) for t in texts]
            head = pa.record_batch([ids, pa.array(n_bytes, pa.int64()), pa.array(extra, pa.int64())], ["id", "n_bytes", "extra"])
            rows = [(-1 - block % buckets, block, to_ipc(head))]
            words = [w.encode() for w in number]
            number.clear()
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            docs = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
            pairs, freq = np.unique(rank[np.concatenate(tokens)] * len(texts) + docs, return_counts=True)
            first = np.searchsorted(bucket[order], np.arange(buckets + 1))
            cut = np.searchsorted(pairs, first * len(texts))
            for b in range(buckets):
                if first[b] < first[b + 1]:
                    mine = [words[i] for i in order[first[b] : first[b + 1]]]
                    at = pairs[cut[b] : cut[b + 1]]
                    found = np.bincount(at // len(texts) - first[b], minlength=len(mine))
                    sizes = np.fromiter(map(len, mine), np.int64, len(mine))
                    rows.append((b, block, pack(np.frombuffer(b"".join(mine), np.uint8), sizes, found, at % len(texts), freq[cut[b] : cut[b + 1]])))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "block", "data"])

    return send


def _join(path: str) -> Callable:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, pieces, before = splitter_of(path), {}, None
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket < 0:
                    out.append(data)
                    continue
                if bucket != before:  # rows come bucket by bucket
                    pieces, before = {}, bucket
                blob, sizes, found, docs, freq = unpack(data)
                ends, blob = np.cumsum(sizes, dtype=np.int64).tolist(), blob.tobytes()
                words = [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                new = [w for w in words if w not in pieces]
                for i in range(0, len(new), 1024):
                    pieces.update(zip(new[i : i + 1024], splitter.pieces([w.decode() for w in new[i : i + 1024]]), strict=True))
                per_word = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
                sums = np.bincount(docs, per_word.repeat(found) * freq).astype(np.int64)
                some = np.flatnonzero(sums)
                out.append(pack(some, sums[some]))
            yield pa.record_batch([pa.array([b < 0 for b in batch.column(0).to_pylist()], pa.bool_()), batch.column(1), pa.array(out, pa.binary())], ["head", "block", "data"])

    return join


def _total(table: pa.Table) -> pa.Table:
    heads = table.column("head").to_pylist()
    head = from_ipc(table.column("data")[heads.index(True)].as_py())
    total = head.column("extra").to_numpy().copy()
    for is_head, data in zip(heads, table.column("data"), strict=True):
        if not is_head:
            docs, sums = unpack(data.as_py())
            total[docs] += sums.astype(np.int64)
    return pa.table({"id": head.column("id"), "n_bytes": head.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, as the tokenizer file gives them without begin and end tokens.

    vocab: a tokenizers file (.json), by path or by name among the public tokenizers; other files are refused. buckets:
    of pre-tokens; one for about BUCKET_BYTES of text, and twice the shuffle partitions at least, unless given. A null or empty text has 0 bytes and tokens; repeated rows and null ids give a
    row each; an empty table gives none; other columns are not read. Special strings count as one token each, as is
    the library's default.
    """
    path, spark = vocabulary(vocab), ship(docs.sparkSession)
    splitter_of(path)
    buckets = buckets or max(64, 2 * shuffle_partitions(spark), -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BUCKET_BYTES))
    kind = dict(docs.select(id_col).dtypes)[id_col]
    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_send(path, buckets), "bucket int, block long, data binary")
    joined = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_join(path), "head boolean, block long, data binary")
    return joined.groupBy("block").applyInArrow(_total, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
