"""Byte-level BPE encoding and decoding of whole texts.

A text no longer than a chunk is split and encoded where it is read. A longer one is cut into overlapping chunks that
are pre-tokenised in parallel. A chunk may begin inside a pre-token, but the splitting pattern never looks back, so
once a chunk and its predecessor share a boundary they agree from there on: stitching keeps the predecessor's pieces
before the first shared boundary and the chunk's own from it. Where a pre-token outlasts the overlap, stitching splits
again from the last sure boundary. Each piece is then encoded by itself. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import vocabulary
from millrace.ship import ship

#: Fixed value: the published splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern decides a match from its first three characters and the one after it.
SIGHT = 3
#: A worker remembers so many pieces.
CACHED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """Ids of a piece as int32 bytes, remembered for the pieces met lately."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.bpe = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        self[piece] = ids = array("i", self.bpe.encode_ordinary(piece)).tobytes()
        return ids

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int32)

    def counted(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes in characters, counts of ids and ids of the pieces."""
        each = list(map(self.__getitem__, pieces))
        return np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), np.int32)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


@lru_cache(maxsize=2)
def tokens_of(path: str) -> np.ndarray:
    """The bytes of each id, read once in a worker's life."""
    ranks = read_ranks(path)
    tokens = np.empty(max(ranks.values()) + 1, object)
    tokens[list(ranks.values())] = list(ranks)
    return tokens


def _gives_back(path: str, ids: np.ndarray, text: str) -> bool:
    """Whether the tokens' bytes one after another are the text's; a text that lost all its tokens is not given back."""
    return b"".join(tokens_of(path)[ids].tolist()) == text.encode()


def _whole(path: str, check: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, find = encoder_of(path), regex.compile(PATTERN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [encoder.ids(find(t)) for t in texts]
                same = [pa.array([_gives_back(path, i, t) for i, t in zip(ids, texts, strict=True)], pa.bool_())] if check else []
                yield pa.record_batch([part.column(0), _lists(ids), *same], ["id", "ids", "same"][: 2 + check])

    return encode


def _chunk(size: int, overlap: int) -> Callable:
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, row = batch.column(2)[i].as_py(), batch.slice(i, 1)
                for start in range(0, len(text), size):
                    last = start + size >= len(text)
                    yield pa.record_batch([row.column(0), row.column(1), pa.array([start], pa.int64()), pa.array([last]), pa.array([text[start : start + size + overlap]])], ["row", "id", "start", "last", "text"])

    return chunk


def _split_chunk(path: str) -> Callable:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, find = encoder_of(path), regex.compile(PATTERN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, counts, ids = [], [], []
                for text in part.column(4).to_pylist():
                    for column, found in zip((sizes, counts, ids), encoder.counted(find(text)), strict=True):
                        column.append(found)
                yield pa.record_batch([*part.columns, _lists(sizes), _lists(counts), _lists(ids)], [*part.schema.names, "sizes", "counts", "ids"])

    return split


def sure_boundaries(sizes: np.ndarray, length: int, last: bool) -> np.ndarray:
    """Starts of a chunk's pieces that do not depend on what follows the chunk, and the end of the last such piece."""
    ends = np.cumsum(np.concatenate([[0], sizes]))
    if last:
        return ends
    doubtful = np.flatnonzero((ends[1:] >= length) | (ends[:-1] + SIGHT > length))
    return ends[: doubtful[0] + 1] if len(doubtful) else ends


class Pieces:
    """Pieces with sure boundaries: bounds[i] to bounds[i + 1] is the i-th; text is what was split, from start on."""

    def __init__(self, start: int, text: str, last: bool, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.start, self.text, self.ids = start, text, ids
        self.bounds = sure_boundaries(sizes, len(text), last) + start
        self.ends = np.cumsum(np.concatenate([[0], counts]))

    def between(self, a: int, b: int) -> np.ndarray:
        """Ids of the pieces from boundary a to boundary b."""
        i, j = np.searchsorted(self.bounds, [a, b])
        return self.ids[self.ends[i] : self.ends[j]]


def stitch_chunks(chunks: list[dict], split: Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The ids of a text from its chunks in order; split gives the sizes, counts and ids of the pieces of a string."""
    out, tail, at = [], None, 0
    for c in chunks:
        own = Pieces(c["start"], c["text"], c["last"], *(np.array(c[k], np.int64) for k in ("sizes", "counts", "ids")))
        if tail is not None:
            shared = np.intersect1d(tail.bounds[tail.bounds >= at], own.bounds, assume_unique=True)
            if len(shared):
                meet = int(shared[0])
            else:
                meet = int(tail.bounds[-1])
                rest = tail.text[meet - tail.start : max(meet, own.start) - tail.start] + own.text[max(0, meet - own.start) :]
                own = Pieces(meet, rest, c["last"], *split(rest))
            out.append(tail.between(at, meet))
            at = meet
        tail = own
    out.append(tail.between(at, int(tail.bounds[-1])))
    return np.concatenate(out)


def _stitch(path: str, check: bool) -> Callable:
    def stitch(table: pa.Table) -> pa.Table:
        def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return encoder_of(path).counted(regex.findall(PATTERN, text))

        chunks = sorted(table.select(["start", "last", "text"]).to_pylist(), key=lambda c: c["start"])
        order = np.argsort(table.column("start").to_numpy(), kind="stable").tolist()
        for name in ("sizes", "counts", "ids"):  # as arrays, not as lists of numbers
            for c, i in zip(chunks, order, strict=True):
                c[name] = table.column(name)[i].values.to_numpy()
        out = {"id": table.column("id").slice(0, 1), "ids": _lists([ids := stitch_chunks(chunks, split)])}
        if check:
            ends = [c["start"] for c in chunks[1:]] + [chunks[-1]["start"] + len(chunks[-1]["text"])]
            out["same"] = pa.array([_gives_back(path, ids, "".join(c["text"][: end - c["start"]] for c, end in zip(chunks, ends, strict=True)))])
        return pa.table(out)

    return stitch


def encode(docs: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 1_024) -> DataFrame:
    """(id, ids) of every row: the token ids of its whole text by the rank file, without special tokens.

    vocab: a rank file, by path or by name among the public tokenizers. Texts over chunk_chars characters are encoded
    in chunks that overlap by overlap_chars; the ids are the same for any sizes. A null or empty text has no ids;
    repeated rows and null ids give a row each; an empty table gives none; other columns are not read.
    """
    return _encoded(docs, vocab, id_col, text_col, chunk_chars, overlap_chars, False)


def encode_checked(docs: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 1_024) -> DataFrame:
    """(id, ids, same) as encode() has them, and whether decoding the ids gives the whole text back.

    A text is encoded, decoded and compared by one worker, so nothing but ids and the flag leaves it.
    """
    return _encoded(docs, vocab, id_col, text_col, chunk_chars, overlap_chars, True)


def _encoded(docs: DataFrame, vocab: str, id_col: str, text_col: str, chunk_chars: int, overlap_chars: int, check: bool) -> DataFrame:
    path = vocabulary(vocab)
    ship(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    result = f"id {kind}, ids array<int>" + (", same boolean" if check else "")
    short = rows.filter(F.coalesce(F.length("text") <= chunk_chars, F.lit(True))).mapInArrow(_whole(path, check), result)
    chunks = rows.filter(F.length("text") > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(_chunk(chunk_chars, overlap_chars), f"row long, id {kind}, start long, last boolean, text string")
    split = chunks.repartition("row", "start").mapInArrow(_split_chunk(path), f"row long, id {kind}, start long, last boolean, text string, sizes array<int>, counts array<int>, ids array<int>")
    long = split.groupBy("row").applyInArrow(_stitch(path, check), result)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def _bytes(path: str) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(part.num_columns - 1)
                out = [b"".join(tokens[x.values.to_numpy(zero_copy_only=False)].tolist()) if x.is_valid else None for x in ids]
                yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken", ids_col: str = "ids") -> DataFrame:
    """The columns of encoded and decoded, the tokens' raw bytes one after another.

    Null ids give null, no ids no bytes; an id outside the vocabulary is an error. An earlier column decoded is replaced.
    """
    ship(encoded.sparkSession)
    rows = encoded.select(*[c for c in encoded.columns if c not in (ids_col, "decoded")], ids_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(_bytes(vocabulary(vocab)), f"{schema}, decoded binary")
