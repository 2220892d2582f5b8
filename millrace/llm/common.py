"""What several training-data operators share: tables, checkpoints, packing and blocks of documents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers, on the machine that asks."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local[...] session, as in tests, may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def until_exit(spark: SparkSession, path: str) -> None:
    """A folder that was written for later steps goes when the driver ends, if nothing drops it before."""
    files, at = _files(spark, path)
    files.deleteOnExit(at)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Lists of what is written now, the innermost temporary() last.
_made: list[list[Saved]] = []


@contextmanager
def temporary() -> Iterator[list[Saved]]:
    """Drops all tables that are written within, but for those that are taken out of the list."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        for saved in _made.pop():
            saved.drop()


class Saved:
    """A DataFrame written to the shared folder, so that what reads it has no lineage; drop() deletes the files.

    Results are lazy, so files that a result still reads stay until the driver ends.
    """

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/millrace-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        until_exit(self.spark, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _made:
            _made[-1].append(self)

    def drop(self) -> None:
        files, at = _files(self.spark, self.path)
        files.delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than one in so many of all rows is hot; there are fewer such keys than this.
HOT = 1000


def join_unique(rows: DataFrame, unique: DataFrame, key: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined to unique, which has one row a key and, in column n, how many rows have the key; n is dropped.

    Rows of hot keys stay where they are: fewer than HOT rows of unique are broadcast for them. All others are shuffled.
    """
    total, most = unique.agg(F.sum(n), F.max(n)).first()
    rest = unique.drop(n)
    if not total or most * HOT <= total:
        return rows.join(rest, key, how)
    hot = unique.filter(F.col(n) * HOT > total)
    theirs = rows.join(F.broadcast(hot.drop(n)), key)
    return theirs.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, how))


#: Most bits of a table of hashes: 16 MB.
TABLE_BITS = 1 << 27


def perhaps_among(hashes: DataFrame, most: int = TABLE_BITS) -> Callable[[str], Column]:
    """A condition on a column of 64-bit hashes that holds for all that the only column of hashes has, and for few others.

    A broadcast table has a bit for each hash modulo its size: 32 bits a hash, and never more than most. Rows that pass
    still have to meet the hashes in a join; those that don't pass need not be shuffled for it.
    """
    (name,), n = hashes.columns, hashes.count()
    bits = min(most, max(1 << 16, 1 << (32 * n).bit_length()))
    at = F.col(name).bitwiseAND(F.lit(bits - 1)).alias("at")
    words = hashes.select(at).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found, table = words.filter("word is not null").toArrow(), np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = hashes.sparkSession.sparkContext.broadcast(table.tobytes())

    def among(hashed: pd.Series) -> pd.Series:
        held, h = np.frombuffer(sent.value, np.uint64), hashed.to_numpy(np.int64).view(np.uint64) & np.uint64(bits - 1)
        return pd.Series((held[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1)

    return F.pandas_udf(among, "boolean")


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays in few bytes: the narrowest type that holds them, then zstandard."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu":
            top = int(a.max(initial=0))
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].strip().decode()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


#: A block is at most so many documents and, unless one document is longer, so many bytes.
BLOCK_DOCS, BLOCK_BYTES = 8192, 4_000_000


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[str]]]:
    """(block number, ids, texts) of (id, text) batches; a null text is empty.

    Numbers are unique over a stage and the same when a task over a file scan runs again.
    """
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right"))), start + BLOCK_DOCS, batch.num_rows)
            yield number, batch.column(0).slice(start, end - start), [t or "" for t in batch.column(1).slice(start, end - start).to_pylist()]
            number, start = number + 1, end


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()
