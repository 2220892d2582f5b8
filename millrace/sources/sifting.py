"""Payloads sifted into entries and what is refused, with the reason and the place, in one pass.

A payload is parsed once, as a VARIANT, and gives a row for each entry of its list or one row if it is refused as a
whole, so that what was read and what was refused add up to what came in. Nothing is dropped without a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many characters of what is refused are kept.
HEAD = 200


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; null for a null variant."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def texts_of(value: Column, path: str) -> Column:
    """The filled texts of a field that may be a text, a list of texts or missing."""
    many, one = F.try_variant_get(value, path, "array<variant>"), F.try_variant_get(value, path, "string")
    return F.filter(F.when(many.isNotNull(), F.transform(many, lambda v: F.try_variant_get(v, "$", "string"))).otherwise(F.array(one)), lambda t: F.coalesce(t, F.lit("")) != "")


def sift(payloads: DataFrame, lists: tuple[str, ...] = ("$",), required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of payloads but body, and pos, entry, reason, head.

    lists: paths of the list of entries, the first that leads to one counts. An entry is an object that has a filled
    value, no list or object, for each required field. reason is null for these; else `empty`, `not JSON`, `no list`, `not an object` or `no <field>`.
    pos: of the entry in the list, from 0; null where the payload is refused as a whole. head: the first HEAD characters
    of what is refused. A list without entries gives one row whose reason is `no entries`.
    """
    rest = [c for c in payloads.columns if c != "body"]
    text = F.trim(F.coalesce("body", F.lit("")))
    # the parser takes no notice of what follows a whole value; within a list it has to
    listed = payloads.select(*rest, "body", F.when(text != "", F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]")))).alias("__w"))
    parsed = listed.select(*rest, "body", F.when(F.size(F.try_variant_get("__w", "$", "array<variant>")) == 1, F.variant_get("__w", "$[0]", "variant")).alias("__v"))
    found = F.coalesce(*[F.when(kind_of(F.variant_get("__v", p, "variant")) == "ARRAY", F.try_variant_get("__v", p, "array<variant>")) for p in lists])
    rows = parsed.select(*rest, "body", "__v", found.alias("__list")).select(*rest, "body", "__v", "__list", F.posexplode_outer("__list").alias("pos", "entry"))
    missing = [F.when(kind_of(F.try_variant_get("entry", f"$.{f}", "variant")).isin("ARRAY", "OBJECT") | (F.coalesce(F.try_variant_get("entry", f"$.{f}", "string"), F.lit("")) == ""), f"no {f}") for f in required]
    of_entry = F.when(F.coalesce(kind_of(F.col("entry")), F.lit("")) != "OBJECT", "not an object").otherwise(F.coalesce(*missing, F.lit(None).cast("string")))
    reason = F.when(text == "", "empty").when(F.col("__v").isNull(), "not JSON").when(F.col("__list").isNull(), "no list").when(F.size("__list") == 0, "no entries").otherwise(of_entry)
    head = F.when(F.col("pos").isNull(), F.col("body")).otherwise(F.to_json("entry"))
    return rows.select(*rest, "pos", "entry", reason.alias("reason"), head.alias("head")).withColumns({"entry": F.when(F.col("reason").isNull(), F.col("entry")), "head": F.when(F.col("reason").isNotNull(), F.substring("head", 1, HEAD))})


def route(sifted: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries and refusals, written below folder in one pass and read again; what is there already is replaced. Entries are JSON text."""
    spark: SparkSession = sifted.sparkSession
    shape = sifted.withColumn("entry", F.to_json("entry")).withColumn("kind", F.when(F.col("reason").isNull(), "entries").otherwise("refused"))
    shape.write.mode("overwrite").partitionBy("kind").parquet(folder)
    back = spark.read.schema(shape.schema).parquet(folder)
    return back.filter("kind = 'entries'").drop("kind", "reason", "head"), back.filter("kind = 'refused'").drop("kind", "entry")


def tally(sifted: DataFrame, by: list[str]) -> DataFrame:
    """What became of the payloads of each group: payloads, whole (not refused as a whole), refused, entries, refused_entries."""
    whole_refusal = F.col("reason").isNotNull() & F.col("pos").isNull() & (F.col("reason") != "no entries")
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    return sifted.groupBy(*by).agg(
        F.count_if(first).alias("payloads"), F.count_if(first & ~whole_refusal).alias("whole"), F.count_if(whole_refusal).alias("refused"),
        F.count_if(F.col("reason").isNull()).alias("entries"), F.count_if(F.col("reason").isNotNull() & F.col("pos").isNotNull()).alias("refused_entries"),
    )
