"""Postings that arrive as files, merged into snapshots of the stored table.

A stream over a drop folder with an available-now trigger handles what has arrived since the last run and ends. The
stored table is kept in buckets of fingerprints. Each micro-batch writes, in a folder named by the batch, only the
buckets that its postings fall into, and the same for an index of (source, source_id), which it reads where its own
postings fall. Last it writes a manifest that says which batch has each bucket, so a batch reads one manifest and no
list of all that went before. A batch that runs again writes the same folders again. Folders of older batches are kept,
so that earlier states can be read, until expire() drops them. When buckets get large, a batch deals the table over
twice as many.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from millrace.functions import facts, text
from millrace.operators.merging import apply_reconciled, merge_batch, reconcile
from millrace.sources.feeds import POSTING

STORED = "id bigint, fingerprint string, " + ", ".join(f"{c} {t}" for c, t in POSTING.items()) + ", sources array<string>, description_source string, stage string"


#: A new table has so many buckets, and twice as many whenever one has more than so many rows on average.
BUCKETS, BUCKET_ROWS = 256, 1_000_000


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []


@dataclass
class Manifest:
    """A batch's view of the table: the greatest id, the number of rows and of buckets, and which batch wrote each bucket of rows and of keys."""

    batch: int = -1
    top: int = 0
    total: int = 0
    buckets: int = BUCKETS
    rows: dict[int, int] = field(default_factory=dict)
    keys: dict[int, int] = field(default_factory=dict)


_MANIFEST = "batch bigint, top bigint, total bigint, buckets int, rows map<int,bigint>, keys map<int,bigint>"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in _listed(spark, f"{folder}/manifests") if n.startswith("batch="))


def _whole(spark: SparkSession, folder: str, n: int) -> bool:
    return "_SUCCESS" in _listed(spark, f"{folder}/manifests/batch={n}")


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole batches in a folder, ascending: those whose manifest is written, which comes last."""
    return [n for n in _batches(spark, folder) if _whole(spark, folder, n)]


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> Manifest:
    """The manifest of the last whole batch, or of the last before a batch; an empty one at the start."""
    last = next((n for n in reversed(_batches(spark, folder)) if (before is None or n < before) and _whole(spark, folder, n)), None)
    return Manifest() if last is None else Manifest(**spark.read.schema(_MANIFEST).parquet(f"{folder}/manifests/batch={last}").first().asDict())


def _held(spark: SparkSession, folder: str, part: str, schema: str, where: dict[int, int], buckets: set[int] | None) -> DataFrame:
    paths = [f"{folder}/{part}batch={n}/bucket={b}" for b, n in sorted(where.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, folder: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The latest of each bucket, or the latest before a batch, of all or of the named buckets; an empty table at the start."""
    return _held(spark, folder, "", STORED, manifest(spark, folder, before).rows, buckets)


def expire(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Drops what none of the last whole batches still has, and says how many folders went. Only those batches can be read from then on."""
    whole = snapshots(spark, folder)
    kept = [manifest(spark, folder, n + 1) for n in whole[-keep:]]
    used = {("", n, b) for m in kept for b, n in m.rows.items()} | {("keys/", n, b) for m in kept for b, n in m.keys.items()}
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, gone = top(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for n in whole[:-keep]:
        for part in ("", "keys/"):
            for name in _listed(spark, f"{folder}/{part}batch={n}"):
                if name.startswith("bucket=") and (part, n, int(name.removeprefix("bucket="))) not in used:
                    gone += bool(files.delete(top(f"{folder}/{part}batch={n}/{name}"), True))
        files.delete(top(f"{folder}/manifests/batch={n}"), True)
    return gone


def prepared(postings: DataFrame, ord_col: str) -> DataFrame:
    """Postings with their fingerprint and facts, one for each fingerprint. Facts that the source states go before those in the text."""
    how = F.coalesce("arrangement", facts.arrangement(F.col("location"), F.col("tags"), F.col("remote")))
    place, years = facts.geo(F.col("location")), facts.experience(F.concat_ws("\n", "title", "description"))
    own_years = F.col("min_years").isNotNull()
    rows = postings.withColumns({
        "fingerprint": text.fingerprint_job(F.col("title"), F.col("company"), F.col("location"), F.col("remote")), "arrangement": facts.row_arrangement(how)["arrangement"],
        "geo_eligibility": F.coalesce("geo_eligibility", place["eligibility"]), "geo_regions": F.coalesce("geo_regions", place["regions"]),
        "min_years": F.when(own_years, F.col("min_years")).otherwise(years["min_years"]), "max_years": F.when(own_years, F.col("max_years")).otherwise(years["max_years"]),
        "experience_text": F.when(own_years, F.col("experience_text")).otherwise(years["experience_text"]),
    })
    return merge_batch(rows, "fingerprint", ord_col)


_KEYS = "source string, source_id string"


def ingest_batch(spark: SparkSession, postings: DataFrame, folder: str, batch: int, ord_col: str = "ord", bucket_rows: int = BUCKET_ROWS) -> None:
    """Merges a batch into the buckets that it falls into and writes these, their keys, and then the manifest."""
    last = manifest(spark, folder, batch)
    grows = last.total > last.buckets * bucket_rows
    buckets = last.buckets * 2 if grows else last.buckets
    of_row, of_key = (lambda n: F.pmod(F.xxhash64("fingerprint"), F.lit(n)).cast("int")), (lambda n: F.pmod(F.xxhash64("source", "source_id"), F.lit(n)).cast("int"))

    def write(rows: DataFrame, part: str, bucket: Column) -> dict[int, int]:
        path = f"{folder}/{part}batch={batch}"
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return {int(b.removeprefix("bucket=")): batch for b in _listed(spark, path) if b.startswith("bucket=")}

    merged = prepared(postings, ord_col).drop(ord_col).persist()
    try:
        # where buckets are dealt anew, all of them are touched
        touched = None if grows else {r[0] for r in merged.select(of_row(last.buckets)).distinct().collect()}
        keyed = None if grows else {r[0] for r in merged.select(of_key(last.buckets)).distinct().collect()}
        stored, known = _held(spark, folder, "", STORED, last.rows, touched), _held(spark, folder, "keys/", _KEYS, last.keys, keyed)
        rows = write(apply_reconciled(stored, merged, reconcile(merged, stored), last.top + 1, known), "", of_row(buckets))
    finally:
        merged.unpersist()
    fresh = spark.read.schema(STORED).parquet(f"{folder}/batch={batch}").filter(F.col("id") > last.top)
    keys = write(known.unionByName(fresh.select("source", "source_id")), "keys/", of_key(buckets))
    most, n = fresh.agg(F.max("id"), F.count("*")).first()
    now = Manifest(batch, most or last.top, last.total + n, buckets, rows if grows else last.rows | rows, keys if grows else last.keys | keys)
    spark.createDataFrame([tuple(vars(now).values())], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/batch={batch}")


def ingest_stream(spark: SparkSession, drop: str, folder: str, checkpoint: str, schema: str | StructType | None = None, per_batch: int = 1000) -> StreamingQuery:
    """A query that merges all Parquet files in the drop folder that no run has seen, at most per_batch files at a time, and ends."""
    schema = schema or ", ".join(f"{c} {t}" for c, t in POSTING.items()) + ", ord bigint"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(drop)
    run = arriving.writeStream.foreachBatch(lambda rows, n: ingest_batch(rows.sparkSession, rows, folder, n))
    return run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
