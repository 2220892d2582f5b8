"""Queries over streams, sifted payloads, settings, caps over whole tables and backfills, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions import facts, lexicon, settings
from millrace.operators import actions, backfill, ranking, schemas, stages
from millrace.plans import adapters as A
from millrace.plans import catalogue
from millrace.sources import mailbox, sifting
from millrace.streaming import retries, watch
from millrace.streaming.folders import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _run_to_end(stream: StreamingQuery) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise RuntimeError(str(stream.exception()))


#: Ten o'clock UTC on 1 May 2024, in seconds.
MAY = 1714557600


@query(f"{catalogue._MAIL} SELECT ord, ref_ord, matched_by, {MAY} + ord % 1000 * 3600 + ord // 1000 % 3600 AS replied, min(ord) OVER (PARTITION BY ref_ord) = ord AS closes FROM best")
def reply_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail as a stream of files in no order of time, and which inbound message closes each thread."""
    turns, folder = A.mail(spark, sf_dir), scratch(spark, "watch")
    sent, at = F.col("role") == "assistant", F.timestamp_seconds(F.lit(MAY) + F.col("turn") * 3600 + F.col("conv_id") % 3600)
    rows = turns.select("ord", sent.alias("sent"), "message_id", "in_reply_to", "references", F.when(sent, F.col("address")).alias("sent_to"), F.when(~sent, F.col("address")).alias("sender"), at.alias("at"))
    rows.repartition(4, "ord").write.parquet(f"{folder}/in")
    _run_to_end(watch.watch_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", per_batch=2))
    found = watch.matches(spark, f"{folder}/out")
    closes = found.groupBy("ref_ord").agg(F.min("ord").alias("first"))
    return found.join(closes, "ref_ord").select("ord", "ref_ord", "matched_by", F.unix_timestamp("replied_at").alias("replied"), (F.col("first") == F.col("ord")).alias("closes"))


_MIXED = '[1, {"id": "x"}, "s", {"title": "no id"}, {"id": ""}, null, {"id": 12, "title": 3.5}, {"id": [1], "title": "t"}, []]'


@query(f"""
    WITH made AS (SELECT doc_id AS payload, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN left(list, length(list) - 5) WHEN 2 THEN '{{"other": 1}}' WHEN 3 THEN '[]' WHEN 4 THEN '{_MIXED}' WHEN 5 THEN NULL
            WHEN 6 THEN '{{"jobs": [{{"id": 7, "title": "t"}}, {{"id": 8}}]}}' WHEN 7 THEN '"[]"' ELSE list END AS body
        FROM (SELECT doc_id, CAST(to_json([{{'id': CAST(doc_id AS VARCHAR), 'title': coalesce(text, 'none')}}, {{'id': 'second', 'title': source}}]) AS VARCHAR) AS list FROM documents)),
    parsed AS (SELECT payload, body, CASE WHEN trim(coalesce(body, '')) <> '' AND json_valid(body) THEN CAST(body AS JSON) END AS v FROM made),
    lists AS (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN v WHEN json_type(v, '$.jobs') = 'ARRAY' THEN json_extract(v, '$.jobs') END AS list FROM parsed),
    entries AS (SELECT payload, i AS pos, json_extract(list, '$[' || i || ']') AS e FROM lists, unnest(range(0, CAST(json_array_length(list) AS BIGINT))) AS x(i) WHERE list IS NOT NULL),
    rows AS (
        SELECT payload, pos, CASE WHEN json_type(e) <> 'OBJECT' THEN 'not an object' WHEN json_type(e, '$.id') IN ('ARRAY', 'OBJECT') OR coalesce(json_extract_string(e, '$.id'), '') = '' THEN 'no id' WHEN coalesce(json_extract_string(e, '$.title'), '') = '' THEN 'no title' END AS reason, e FROM entries
        UNION ALL SELECT payload, NULL, CASE WHEN trim(coalesce(body, '')) = '' THEN 'empty' WHEN v IS NULL THEN 'not JSON' WHEN list IS NULL THEN 'no list' ELSE 'no entries' END, NULL FROM lists WHERE list IS NULL OR json_array_length(list) = 0)
    SELECT payload, CAST(pos AS INTEGER) AS pos, reason, CASE WHEN reason IS NULL THEN json_extract_string(e, '$.id') END AS id, CASE WHEN reason IS NULL THEN md5(json_extract_string(e, '$.title')) END AS title FROM rows""")
def payloads_sifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are whole, cut, empty, of another shape or with odd entries: what each gives and why the rest is refused."""
    key = F.col("doc_id")
    whole = F.to_json(F.array(F.struct(key.cast("string").alias("id"), F.coalesce("text", F.lit("none")).alias("title")), F.struct(F.lit("second").alias("id"), F.col("source").alias("title"))))
    odd = {0: "", 2: '{"other": 1}', 3: "[]", 4: _MIXED, 5: None, 6: '{"jobs": [{"id": 7, "title": "t"}, {"id": 8}]}', 7: '"[]"'}
    body = F.when(key % 9 == 1, F.substring(whole, F.lit(1), F.length(whole) - 5)).when(key % 9 == 8, whole)
    for n, value in odd.items():
        body = body.when(key % 9 == n, F.lit(value).cast("string"))
    found = sifting.sift(A.table(spark, sf_dir, "documents").select(key.alias("payload"), body.alias("body")), ("$", "$.jobs"), ("id", "title"))
    return found.select("payload", "pos", "reason", F.try_variant_get("entry", "$.id", "string").alias("id"), F.md5(F.try_variant_get("entry", "$.title", "string")).alias("title"))


_HOSTS = ['"mail.example.org"', '""', "7", "null", '"x"']
_FLAGS = ["true", "false", '"true"', "1", "null"]
#: A document of settings as an expression that Spark and DuckDB both read.
_SETTINGS = "CASE WHEN o_orderkey % 17 = 0 THEN 'not JSON' WHEN o_orderkey % 19 = 0 THEN '[1]' ELSE concat('{\"MATCH_THRESHOLD\": ', CAST(o_orderkey % 140 - 10 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '.5' WHEN o_orderkey % 3 = 1 THEN '.0' ELSE '' END, ', \"DRY_RUN\": ', $flag, ', \"IMAP_HOST\": ', $host, ', \"FOLLOWUP_FIRST_DAYS\": ', CAST(o_orderkey % 70 AS STRING), ', \"FOLLOWUP_FINAL_DAYS\": \"', CAST(o_orderkey % 9 AS STRING), '\", \"IMAP_PORT\": {\"a\": 1}, \"unknown\": 1}') END"


@query(f"""
    WITH docs AS (SELECT o_orderkey, {_SETTINGS.replace("$flag", A.pick_sql("o_orderkey", _FLAGS)).replace("$host", A.pick_sql("(o_orderkey // 5)", _HOSTS)).replace("AS STRING", "AS VARCHAR")} AS doc FROM orders),
    told AS (SELECT *, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS good, o_orderkey % 140 - 10 AS m, o_orderkey % 70 AS f FROM docs),
    plain AS (
        SELECT o_orderkey, CASE WHEN good AND o_orderkey % 3 <> 0 AND m BETWEEN 0 AND 100 THEN m ELSE 40 END AS threshold, good AND o_orderkey % 5 = 0 AS dry_run,
            CASE WHEN good AND (o_orderkey // 5) % 5 = 0 THEN 'mail.example.org' WHEN good AND (o_orderkey // 5) % 5 = 4 THEN 'x' ELSE 'imap.gmail.com' END AS host, CASE WHEN good AND f BETWEEN 1 AND 60 THEN f ELSE 4 END AS first_days FROM told)
    SELECT o_orderkey, threshold, dry_run, host, first_days, 10 AS final_days, 993 AS port, CASE WHEN 10 <= first_days THEN 1 ELSE 0 END AS problems FROM plain""")
def settings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with values of the wrong kind, out of bounds, missing or no JSON at all: each bad key falls back by itself."""
    key = F.col("o_orderkey")
    made = A.table(spark, sf_dir, "orders").select(key, A.pick(key, _FLAGS).alias("flag"), A.pick(F.floor(key / 5), _HOSTS).alias("host"))
    docs = made.select(key, F.expr(_SETTINGS.replace("$flag", "flag").replace("$host", "host")).alias("doc")).withColumn("s", settings.parse_settings(F.col("doc")))
    return docs.select(
        key, F.col("s.MATCH_THRESHOLD").alias("threshold"), settings.dry_run(F.col("s")).alias("dry_run"), F.col("s.IMAP_HOST").alias("host"), F.col("s.FOLLOWUP_FIRST_DAYS").alias("first_days"),
        F.col("s.FOLLOWUP_FINAL_DAYS").alias("final_days"), F.col("s.IMAP_PORT").alias("port"), F.size(settings.problems(F.col("s"))).alias("problems"),
    )


@query("""SELECT o_orderkey, o_orderstatus = 'O' AND sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) <= 5000 AS allowed FROM orders""")
def cap_over_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five thousand open orders of the whole table, as one group that no task orders by itself."""
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return stages.within_cap_spread(rows, [], "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "O", F.lit(0), 5000, stretch=1000).select("o_orderkey", "allowed")


PLACES = [("Berlin (hybrid)", "hybrid"), ("Remote, Worldwide", "remote"), ("On-site in Austin, United States", "onsite"), (None, None), ("Pune, India", None)]
CARD_TITLE = "Data Engineer · Remote, Worldwide Easy Apply"
_AGES = [None, 0, facts.DERIVED_VERSION]


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, card = F.col("id"), F.col("id") % 11 == 0
    return A.queue(spark, sf_dir).withColumns({
        "source": F.when(card, "linkedin_alert").otherwise("remoteok"), "title": F.when(card, CARD_TITLE).otherwise(F.col("title")), "location": A.pick(key, [p[0] for p in PLACES]), "easy_apply": F.lit(None).cast("boolean"),
        "remote": F.when(key % 4 == 0, True).when(key % 4 == 1, False), "facts_version": A.pick(key, [None if a is None else str(a) for a in _AGES]).cast("int"), "experience_text": F.lit("stale"),
        "score": F.lit(1), "score_reasons": F.array().cast("array<string>"), "last_error": F.lit(None).cast("string"),
    })


_HOW_SQL = "coalesce(CASE WHEN id % 11 = 0 THEN 'remote' END, CASE id % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'remote' WHEN 2 THEN 'onsite' END, CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' END)"
_GEO_SQL = "CASE WHEN id % 11 = 0 THEN 'worldwide' ELSE CASE id % 5 WHEN 1 THEN 'worldwide' WHEN 2 THEN 'restricted' WHEN 4 THEN 'eligible' ELSE 'unknown' END END"


@query(f"""
    WITH {A.QUEUE_SQL}, old AS (SELECT * FROM queue WHERE id % 3 < 2),
    sides AS (
        SELECT id, arrangement AS how, geo_eligibility AS geo, status, stage, min_years, 'before' AS side FROM old
        UNION ALL SELECT id, {_HOW_SQL}, {_GEO_SQL}, CASE WHEN status IN ('rejected', 'found') THEN 'found' ELSE status END, CASE WHEN status IN ('rejected', 'found') THEN 'score' ELSE stage END, NULL, 'after' FROM old),
    long AS (
        SELECT 'arrangement' AS fact, how AS value, side FROM sides UNION ALL SELECT 'geo_eligibility', geo, side FROM sides UNION ALL SELECT 'status', status, side FROM sides
        UNION ALL SELECT 'stage', stage, side FROM sides UNION ALL SELECT 'min_years', CAST(min_years AS VARCHAR), side FROM sides)
    SELECT fact, coalesce(value, 'null') AS value, count(*) FILTER (side = 'before') AS before, count(*) FILTER (side = 'after') AS after FROM long GROUP BY ALL""")
def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backfill would change, fact by fact; nothing is written."""
    rows = _stored(spark, sf_dir)
    after = backfill.backfilled(rows, facts.DERIVED_VERSION, catalogue.PROFILE, A.NOW)
    return backfill.histogram(rows, after, ["arrangement", "geo_eligibility", "status", "stage", "min_years"])


@query(f"""WITH {A.QUEUE_SQL} SELECT id, CASE WHEN id % 3 < 2 THEN {_HOW_SQL} ELSE arrangement END AS arrangement, CASE WHEN id % 3 < 2 THEN {_GEO_SQL} ELSE geo_eligibility END AS geo_eligibility,
    CASE WHEN id % 11 = 0 AND id % 3 < 2 THEN 'Data Engineer' WHEN id % 11 = 0 THEN {A.quoted(CARD_TITLE)} ELSE title END AS title, id % 3 < 2 AS changed, CASE WHEN id % 3 < 2 AND status IN ('rejected', 'found') THEN 'found' ELSE status END AS status,
    CASE WHEN id % 3 < 2 THEN NULL ELSE 'stale' END AS experience_text FROM queue""")
def facts_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table after the backfill, changed or not."""
    after = backfill.backfilled(_stored(spark, sf_dir), facts.DERIVED_VERSION, catalogue.PROFILE, A.NOW)
    return after.select("id", "arrangement", "geo_eligibility", "title", "changed", "status", "experience_text")


@query(f"""WITH {A.QUEUE_SQL}, told AS (SELECT *, id % 11 = 0 AND id % 2 = 0 AND status IN ('rejected', 'found') AND id % 7 <> 0 AND id % 13 <> 0 AS goes FROM queue)
    SELECT id, goes AS requeued, CASE WHEN goes THEN 'enrich' ELSE stage END AS stage, CASE WHEN goes THEN 0 ELSE attempts END AS attempts, CASE WHEN goes THEN NULL ELSE next_attempt_at END AS next_attempt_at FROM told""")
def requeued_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert cards without a company go back to fetching, unless their page was fetched before or has no number."""
    key = F.col("id")
    rows = _stored(spark, sf_dir).withColumns({"company": F.when(key % 2 == 0, "Unknown").otherwise("Acme"), "url": F.when(key % 7 != 0, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), key.cast("string"))).otherwise("https://x.org/"), "attempts": F.col("attempts").cast("int")})
    cache = A.table(spark, sf_dir, "orders").filter("o_orderkey % 13 = 0").select(F.col("o_orderkey").cast("string").alias("job_id"))
    return backfill.requeued(rows, cache).select("id", "requeued", "stage", F.col("attempts").cast("long").alias("attempts"), "next_attempt_at")


@query(f"""SELECT doc_id, 'box' || doc_id % 3 AS folder, '<' || doc_id || '@x>' AS message_id, {MAY} + 86400 * (doc_id % 28) AS sent, md5(trim(coalesce(text, ''), chr(10))) AS body
    FROM documents WHERE doc_id % 28 >= 14 AND doc_id % 3 < 2 AND doc_id % 5 > 0""")
def mailbox_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as messages in mbox files of three folders, read by folder, sender's domain and date; null texts are empty messages."""
    key, folder = F.col("doc_id"), scratch(spark, "mailbox")
    date = F.date_format(F.timestamp_seconds(F.lit(MAY) + 86400 * (key % 28)), "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    lines = [
        F.lit("From x"), F.concat(F.lit("From: Ann <ann@"), F.when(key % 5 > 0, "jobs.example").otherwise("else.example"), F.lit(">")), F.concat(F.lit("Subject: "), key.cast("string")), F.concat(F.lit("Date: "), date),
        F.concat(F.lit("Message-ID: <"), key.cast("string"), F.lit("@x>")), F.lit("MIME-Version: 1.0"), F.lit("Content-Transfer-Encoding: 8bit"), F.lit("Content-Type: text/html; charset=utf-8"), F.lit(""),
        F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^(>*From )", ">$1"),
    ]
    rows = A.table(spark, sf_dir, "documents").select(F.array_join(F.array(*lines), "\n").alias("value"), F.concat(F.lit("box"), (key % 3).cast("string")).alias("folder"))
    for name in ("box0", "box1", "box2"):
        rows.filter(F.col("folder") == name).select("value").write.text(f"{folder}/{name}")
    box = mailbox.read_mailbox(spark, folder)
    late = box.filter((F.col("date") >= F.timestamp_seconds(F.lit(MAY + 86400 * 14))) & F.col("folder").isin("box0", "box1") & (F.col("domain") == "jobs.example"))
    own = F.trim(F.regexp_replace("html", "\r\n", "\n"), F.lit("\n"))
    return late.select(F.col("subject").cast("long").alias("doc_id"), "folder", "message_id", F.unix_timestamp("date").alias("sent"), F.md5(own).alias("body"))


@query("""SELECT o_orderkey AS id, 'orders' AS source, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS BIGINT) WHEN 1 THEN CAST(o_custkey % 100 AS BIGINT) ELSE o_custkey + 5000000000 END AS amount,
    CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderstatus || ',x' ELSE '' END AS tags, CASE WHEN o_orderkey % 3 = 2 THEN 'score' ELSE 'done' END AS stage, CASE WHEN o_orderkey % 3 = 2 THEN 'a' ELSE 'orders' END AS sources,
    CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS price, 'v' || (o_orderkey % 3 + 1) AS version FROM orders""")
def schema_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table whose columns were added, widened and turned into lists, as one; rows of versions without a stage are done."""
    folder, key = scratch(spark, "versions"), F.col("o_orderkey")
    orders = A.table(spark, sf_dir, "orders").withColumn("source", F.lit("orders"))
    orders.filter(key % 3 == 0).select(key.cast("int").alias("id"), "source", F.col("o_custkey").cast("int").alias("amount"), F.col("o_orderstatus").alias("tags")).write.parquet(f"{folder}/v1")
    orders.filter(key % 3 == 1).select(key.alias("id"), "source", (F.col("o_custkey") % 100).cast("smallint").alias("amount"), F.array("o_orderstatus", F.lit("x")).alias("TAGS"), F.col("o_totalprice").alias("price")).write.parquet(f"{folder}/v2")
    orders.filter(key % 3 == 2).select(key.alias("id"), "source", (F.col("o_custkey") + 5_000_000_000).alias("amount"), F.array().cast("array<string>").alias("tags"), F.lit("score").alias("stage"), F.array(F.lit("a")).alias("sources")).write.parquet(f"{folder}/v3")
    rows = schemas.reconciled(schemas.stored_versions(spark, folder), ["source", "id"], {"stage": F.lit("done"), "sources": F.array("source")}, "version")
    return rows.select("id", "source", "amount", F.array_join("tags", ",").alias("tags"), "stage", F.array_join("sources", ",").alias("sources"), "price", "version")


@query(f"""WITH {A.POOL_SQL}, {A.STATE_SQL} SELECT p.id, s.user_id, s.status, p.title FROM pool p LEFT JOIN state s ON s.job_id = p.id""")
def stored_pool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every viewer's state beside the pool, both kept in buckets of the posting's id, so that neither is shuffled again."""
    folder = scratch(spark, "buckets")
    name = folder.rsplit("-", 1)[1]
    ranking.store_by_id(A.pool(spark, sf_dir).select("id", "title"), f"pool_{name}", f"{folder}/pool", "id", 8)
    ranking.store_by_id(A.viewer_state(spark, sf_dir), f"state_{name}", f"{folder}/state", "job_id", 8)
    return ranking.stored_with_viewer_state(spark.table(f"pool_{name}"), spark.table(f"state_{name}")).select("id", "user_id", "status", "title")


_MARKS = "marks AS (SELECT event_id AS ord, CASE WHEN event_id % 9 = 0 THEN -event_id WHEN event_id % 9 = 1 THEN NULL WHEN event_id % 9 = 2 THEN event_id + 1000000000 ELSE user_id END AS job_id, CASE event_type WHEN 'error' THEN true WHEN 'click' THEN false END AS undo FROM events)"


@query(f"""WITH {_MARKS}, last AS (SELECT job_id, coalesce(undo, false) AS undone FROM marks WHERE job_id IN (SELECT o_orderkey FROM orders) AND job_id > 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ord DESC) = 1)
    SELECT o_orderkey AS id, CASE WHEN undone THEN 'ready_for_review' WHEN NOT undone THEN 'applied' ELSE o_orderstatus END AS status, CASE WHEN undone IS NULL OR o_orderkey % 2 = 0 THEN 'old' WHEN undone THEN 'ready_for_review' ELSE 'sent' END AS application,
        CASE WHEN undone IS NULL OR o_orderkey % 2 = 0 THEN 1 WHEN undone THEN NULL ELSE 2 END AS sent FROM orders LEFT JOIN last ON job_id = o_orderkey
    UNION ALL SELECT job_id, 'refused', CASE WHEN job_id IS NULL OR job_id <= 0 THEN 'a positive id is needed' ELSE 'job not found' END, NULL FROM marks WHERE job_id IS NULL OR job_id <= 0 OR job_id NOT IN (SELECT o_orderkey FROM orders)""")
def marks_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks of postings: which postings and applications follow, and which marks are refused."""
    event, key = F.col("event_id"), F.col("o_orderkey")
    target = F.when(event % 9 == 0, -event).when(event % 9 == 1, F.lit(None)).when(event % 9 == 2, event + 1_000_000_000).otherwise(F.col("user_id"))
    marks = A.table(spark, sf_dir, "events").select(event.alias("ord"), target.cast("long").alias("job_id"), F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "click", False).alias("undo"))
    orders = A.table(spark, sf_dir, "orders")
    jobs = orders.select(key.alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    applications = orders.select(key.alias("job_id"), F.when(key % 2 == 1, "manual_portal").otherwise("auto").alias("send_mode"), F.lit("old").alias("status"), F.timestamp_seconds(F.lit(1)).alias("sent_at"))
    after, sent, refused = actions.mark_applied(jobs, applications, marks, A.NOW)
    when = F.when(F.col("sent_at") == F.lit(A.NOW), 2).when(F.col("sent_at").isNotNull(), 1)
    both = after.join(sent.select(F.col("job_id").alias("id"), F.col("status").alias("application"), when.alias("sent")), "id").select("id", "status", "application", "sent")
    return both.unionByName(refused.select(F.col("job_id").alias("id"), F.lit("refused").alias("status"), F.col("reason").alias("application"), F.lit(None).cast("int").alias("sent")))


@query("""WITH lines AS (SELECT user_id % 40 AS run_id, event_id AS ord, CASE WHEN event_type = 'error' THEN 'error' ELSE 'notice' END AS kind, event_type || ' ' || event_id AS text FROM events WHERE event_type IN ('error', 'view') AND user_id % 7 > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY ord) AS n, count(*) OVER (PARTITION BY run_id, kind) AS total FROM lines),
    parts AS (
        SELECT run_id, kind, kind || 's (' || max(total) || '):' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY ord) || CASE WHEN max(total) > count(*) THEN chr(10) || '- and ' || (max(total) - count(*)) || ' more' ELSE '' END AS part, max(total) AS total
        FROM ranked WHERE n <= CASE kind WHEN 'error' THEN 40 ELSE 20 END GROUP BY run_id, kind),
    runs AS (SELECT DISTINCT user_id % 40 AS run_id FROM events)
    SELECT r.run_id, coalesce(e.total, 0) AS n_errors, coalesce(n.total, 0) AS n_notices, coalesce(e.part, 'no errors') || coalesce(chr(10) || n.part, '') AS report
    FROM runs r LEFT JOIN parts e ON e.run_id = r.run_id AND e.kind = 'error' LEFT JOIN parts n ON n.run_id = r.run_id AND n.kind = 'notice'""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row for each run, of which only the first lines are shown and all are counted."""
    events = A.table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id") % 40)
    kind = F.when(F.col("event_type") == "error", "error").otherwise("notice")
    lines = events.filter(F.col("event_type").isin("error", "view") & (F.col("user_id") % 7 > 0)).select("run_id", F.col("event_id").alias("ord"), kind.alias("kind"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("text"))
    return actions.run_log(events.select("run_id").distinct(), lines)


#: Seconds between one failure of all rows and the next; each waits less.
_ROUND = 25_000


@query(f"""WITH tries AS (SELECT s_suppkey AS id, CAST(k AS INTEGER) AS k FROM supplier, range(1, {lexicon.MAX_ATTEMPTS} + 2) AS r(k) WHERE k <= s_suppkey % 6 + 1 AND k <= {lexicon.MAX_ATTEMPTS}),
    waits AS (SELECT id, k, {MAY} + k * {_ROUND} AS happened, least(60 * pow(2, k - 1), 21600)::BIGINT + id % 17 AS wait FROM tries)
    SELECT id, k AS attempts, CASE WHEN k = {lexicon.MAX_ATTEMPTS} THEN 'given up' ELSE 'waiting' END AS change, happened, CASE WHEN k < {lexicon.MAX_ATTEMPTS} THEN happened + wait END AS due FROM waits
    UNION ALL SELECT id, k, 'due', happened + wait, happened + wait FROM waits WHERE k < {lexicon.MAX_ATTEMPTS}""")
def retry_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that fail again and again over a scripted day: when each waits, is due and is given up."""
    folder, key = scratch(spark, "retries"), F.col("s_suppkey")
    rows = A.table(spark, sf_dir, "supplier").select(key.alias("id"), (key % 6).alias("attempts"))
    for k in range(1, lexicon.MAX_ATTEMPTS + 1):
        at, tick = F.timestamp_seconds(F.lit(MAY + k * _ROUND)), F.timestamp_seconds(F.lit(MAY + (k + 1) * _ROUND - 1))
        events = rows.filter(F.col("attempts") + 1 >= k).select("id", F.lit("failed").alias("kind"), at.alias("at"), F.lit("x").alias("error"))
        events.coalesce(1).write.parquet(f"{folder}/in/{k}-failed")
        # the clock goes on to just before the next failure
        spark.range(1).select((-F.col("id") - 1).alias("id"), F.lit("tick").alias("kind"), tick.alias("at"), F.lit(None).cast("string").alias("error")).coalesce(1).write.parquet(f"{folder}/in/{k}-tick")
    _run_to_end(retries.retry_stream(spark, f"{folder}/in/*", f"{folder}/out", f"{folder}/state", per_batch=1))
    return retries.changes(spark, f"{folder}/out").select("id", "attempts", "change", F.unix_timestamp("at").alias("happened"), F.unix_timestamp("due").alias("due"))
