"""Merging the same posting from several feeds, and changing snapshots of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.facts import experience
from millrace.functions.text import informative_length


def join_filled(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with the columns of known that have their key, and nulls where there is none.

    Rows without a key go around the join, which would bring all of them to the one task that nulls are hashed to.
    """
    return rows.filter(F.col(key).isNotNull()).join(known, key, "left").unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark cuts each partition to one row a key before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def latest_child(children: DataFrame, parent: str, child: str) -> DataFrame:
    """The child of the greatest id of each parent, with all its columns; of repeated ids the greatest by the other columns."""
    rest = [c for c in children.columns if c not in (parent, child)]
    return children.groupBy(parent).agg(F.max(F.struct(child, *rest)).alias("x")).select(parent, "x.*")


def merge_batch(rows: DataFrame, key: str, ord_col: str, richest: str = "description", first_filled: tuple[str, ...] = ("apply_email", "salary_text"), source: str = "source") -> DataFrame:
    """One row for each key of a batch, the same however the batch is partitioned.

    The earliest row gives every column but these: richest is the most informative filled text (of equals the earliest),
    first_filled are the earliest filled values, sources are the distinct sources in order. ord_col is of any ordered type
    and tells rows apart.
    """
    others = [c for c in rows.columns if c not in (key, richest, *first_filled)]
    filled = F.trim(F.coalesce(F.col(richest), F.lit(""))) != ""
    aggregates = [
        F.min_by(F.struct(*others), ord_col).alias("__first"),
        F.min_by(F.col(richest), F.when(filled, F.struct((-informative_length(F.col(richest))).alias("n"), F.col(ord_col).alias("o")))).alias(richest),
        *[F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(ord_col))).alias(c) for c in first_filled],
    ]
    firsts = rows.groupBy(key, source).agg(F.min(ord_col).alias("o")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", source))), lambda s: s[source]).alias("sources"))
    merged = rows.groupBy(key).agg(*aggregates)
    return merged.join(firsts, key).select(key, "__first.*", richest, *first_filled, "sources")


def reconcile(batch: DataFrame, stored: DataFrame, blank: int = -1) -> DataFrame:
    """What a merged batch does to the stored rows, by fingerprint: insert, skip or merge, with the values to write.

    Of stored rows with one fingerprint the last id counts. A candidate that is the stored row itself is skipped. A
    merge keeps the richer text (the stored one of equals), the stored e-mail if there is one, and all sources; where
    the text changed, experience is derived again and the row goes back to scoring. A blank text counts blank; at -1 any
    other text is richer, at 0 only one that informs.
    """
    last = latest_child(stored, "fingerprint", "id").select("fingerprint", *[F.col(c).alias(f"s_{c}") for c in ("id", "source", "source_id", "sources", "description", "apply_email")])
    both = batch.join(last, "fingerprint", "left")
    same = (F.col("source") == F.col("s_source")) & (F.col("source_id") == F.col("s_source_id"))
    action = F.when(F.col("s_id").isNull(), "insert").when(same, "skip").otherwise("merge")

    def info(c: str) -> Column:
        return F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", informative_length(F.col(c))).otherwise(blank)

    merging = action == "merge"
    # each from an array of one, so that a text is measured and searched once, however many columns follow from it
    richer = F.when(info("description") > info("s_description"), F.col("description")).otherwise(F.col("s_description"))
    both = both.select("*", F.explode(F.array(F.when(merging, F.when(F.col("description").eqNullSafe(F.col("s_description")), F.col("s_description")).otherwise(richer)))).alias("__richer"))
    richer = F.col("__richer")
    gained = merging & ~richer.eqNullSafe(F.col("s_description"))
    both = both.select("*", F.explode(F.array(F.when(gained, experience(F.concat_ws("\n", "title", richer))))).alias("__derived"))
    derived = F.col("__derived")
    return both.select(
        "fingerprint", action.alias("action"), F.coalesce("s_id", F.lit(None)).alias("stored_id"), "source", "source_id",
        F.when(merging, richer).otherwise(F.col("description")).alias("description"),
        F.when(merging, F.coalesce(F.nullif("s_apply_email", F.lit("")), "apply_email")).otherwise(F.col("apply_email")).alias("apply_email"),
        F.when(merging, F.array_distinct(F.concat(F.coalesce("s_sources", F.array()), F.array("s_source"), "sources"))).otherwise(F.col("sources")).alias("sources"),
        F.when(gained, F.concat(F.lit("merged:"), F.col("source"))).alias("description_source"),
        F.when(gained | ((action == "insert") & (F.coalesce("description", F.lit("")) != "")), "score").when(action == "insert", "enrich").alias("stage"),
        F.when(gained, derived["min_years"]).alias("min_years"), F.when(gained, derived["max_years"]).alias("max_years"),
    )


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table and those rows whose key it lacks; of rows with one key the first goes in."""
    return table.unionByName(keep_first(rows, keys, order).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after changes, one a key at most: columns in keep hold their old value where the row was there."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in table.columns if c not in keys], F.lit(True).alias("__new"))
    joined = table.withColumn("__old", F.lit(True)).join(new, keys, "full")
    return joined.select(*[c if c in keys else F.when(F.col("__new").isNull() | (F.col("__old") & F.lit(c in keep)), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in table.columns])


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_active(rows: DataFrame, keys: list[str], order: list[Column], flag: str) -> DataFrame:
    """flag: whether a row is the first of its key."""
    return rows.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def revoke_then_insert(table: DataFrame, rows: DataFrame, keys: list[str], revoked_col: str, now: Column) -> DataFrame:
    """The table with its open rows of the new rows' keys revoked, and the new rows."""
    hit = rows.select(*keys).distinct().withColumn("__hit", F.lit(True))
    closed = table.join(hit, keys, "left").withColumn(revoked_col, F.when(F.col("__hit") & F.col(revoked_col).isNull(), now).otherwise(F.col(revoked_col)))
    return closed.select(*table.columns).unionByName(rows.select(*table.columns))


def fill_owner(rows: DataFrame, owner: int, column: str = "user_id") -> DataFrame:
    """Rows without an owner get this one."""
    return rows.withColumn(column, F.coalesce(column, F.lit(owner)))


#: Ids are dealt over so many buckets of keys, whose sizes are all that one task adds up.
ID_BUCKETS = 1024


def assign_ids(rows: DataFrame, keys: list[str], start: int, id_col: str = "id") -> DataFrame:
    """Rows with ids from start on, without gaps and the same however the rows are partitioned; keys tell the rows apart."""
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(ID_BUCKETS)))
    before = F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("__b").agg(F.count("*").alias("n")).select("__b", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*keys))
    return dealt.withColumn("__p", place).join(offsets, "__b").withColumn(id_col, F.lit(start) + F.col("__before") + F.col("__p") - 1).drop("__b", "__p", "__before")


def apply_reconciled(stored: DataFrame, batch: DataFrame, found: DataFrame, next_id: int, known: DataFrame | None = None) -> DataFrame:
    """The stored rows after what reconcile() found for a batch; inserted rows get ids from next_id on.

    A candidate whose source and source_id are stored already, under another fingerprint, is not inserted. known has
    these two of the whole table where stored is only a part of it.
    """
    changed = ["description", "apply_email", "sources", "description_source", "stage", "min_years", "max_years"]
    merges = found.filter("action = 'merge'").select(F.col("stored_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in changed])
    gained = F.col("__description_source").isNotNull()
    always = {c: F.when(F.col("__sources").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("description", "apply_email", "sources")}
    on_gain = {c: F.when(gained, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("description_source", "stage", "min_years", "max_years")}
    kept = stored.join(merges, "id", "left").withColumns(always | on_gain).select(*stored.columns)
    inserts = found.filter("action = 'insert'").select("fingerprint", "stage").join(batch.drop("stage"), "fingerprint")
    fresh = keep_first(inserts, ["source", "source_id"], [F.col("fingerprint")]).join((stored if known is None else known).select("source", "source_id"), ["source", "source_id"], "left_anti")
    return kept.unionByName(assign_ids(fresh, ["fingerprint"], next_id).select(*[F.col(c) if c in fresh.columns or c == "id" else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes]))
