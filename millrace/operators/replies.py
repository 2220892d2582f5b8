"""Which sent message an inbound one answers, by strict precedence of three rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import lexicon as L
from millrace.functions.text import extract_address, message_id


def ignore_reason(sender: Column, headers: Column, self_address: str = "") -> Column:
    """Why a message is not read, or null; the first rule that holds. Header names count in any case."""
    folded = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])), F.coalesce(e["value"], F.lit(""))))))

    def header(name: str) -> Column:
        return F.try_element_at(folded, F.lit(name))

    address = extract_address(sender)
    local = F.regexp_extract(address, "^(.*)@", 1)
    auto = F.lower(F.trim(F.split(header("auto-submitted"), ";")[0]))
    return (
        F.when((F.lit(self_address) != "") & (address == self_address.lower()), "self")
        .when(header("return-path").isNotNull() & (extract_address(header("return-path")) == ""), "bounce:null-return-path")
        .when(F.lower(header("content-type")).contains("multipart/report"), "bounce:report")
        .when(local.isin(L.BOUNCE_SENDERS), "bounce:sender").when(local.isin(L.UNATTENDED_SENDERS), "unattended:sender")
        .when(auto != "no", "auto-reply:auto-submitted").when(header("x-autoreply").isNotNull(), "auto-reply:x-autoreply")
        .when(header("x-autorespond").isNotNull(), "auto-reply:x-autorespond").when(F.lower(F.trim(header("precedence"))).isin(L.AUTO_PRECEDENCE), "auto-reply:precedence")
    )


def match_replies(sent: DataFrame, inbound: DataFrame) -> DataFrame:
    """(inbound ord, ref_ord, matched_by): at most one match for each inbound message.

    sent: ord, message_id, sent_to; inbound: ord, in_reply_to, references, sender. in-reply-to goes before references,
    the last reference before earlier ones, references before the sender. Of sent messages with one id or recipient the
    first listed counts. Three equi-joins, so no inbound message meets a sent one that it does not name.
    """
    by_id = sent.withColumn("key", message_id(F.col("message_id"))).filter("key != ''").groupBy("key").agg(F.min("ord").alias("ref_ord"))
    by_to = sent.withColumn("key", extract_address(F.col("sent_to"))).filter("key != ''").groupBy("key").agg(F.min("ord").alias("ref_ord"))
    direct = inbound.select("ord", F.lit(0).alias("rule"), F.lit(0).alias("at"), message_id(F.col("in_reply_to")).alias("key"))
    thread = inbound.select("ord", F.posexplode("references").alias("p", "r")).select("ord", F.lit(1).alias("rule"), (-F.col("p")).alias("at"), message_id(F.col("r")).alias("key"))
    sender = inbound.select("ord", F.lit(2).alias("rule"), F.lit(0).alias("at"), extract_address(F.col("sender")).alias("key"))
    found = direct.unionAll(thread).join(by_id, "key").unionByName(sender.join(by_to, "key"))
    best = found.groupBy("ord").agg(F.min_by(F.struct("ref_ord", "rule"), F.struct("rule", "at")).alias("m"))
    names = F.array(F.lit("in-reply-to"), F.lit("references"), F.lit("sender"))
    return best.select("ord", "m.ref_ord", names[F.col("m.rule")].alias("matched_by"))


def first_reply(matches: DataFrame) -> DataFrame:
    """The first inbound message for each sent one."""
    return matches.withColumn("n", F.row_number().over(Window.partitionBy("ref_ord").orderBy("ord"))).filter("n = 1").drop("n")
