"""Views of general tables in the shapes that the operators take, as DataFrames and as SQL for the same rows.

Orders are a pool of postings, events the triage of viewers, documents long descriptions, conversations mail. Each
view is a plain projection, so it is pruned and pushed down like one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The viewer, the clock, the window in days and the last visit that the queries use.
VIEWER, NOW, WINDOW, LAST_SEEN = 13, datetime(2001, 8, 1), 365, datetime(2001, 7, 1)

TITLES = ["Senior React Developer", "Developer, Node.js", "Sales Engineer - Platform", "Data Engineering Intern", "Full Stack Engineer / Python", "Data Engineer (SQL)", "Account Manager"]
DESCRIPTIONS = [None, "Work with React, Node and SQL daily.", "Python services, reactjs front ends", "sqlite only", "SQLs and Pythonic code"]
ARRANGEMENTS = ["remote", "hybrid", "onsite", "unknown", None]
ELIGIBILITY = ["restricted", "worldwide", "eligible", None]
STATUS_OF_EVENT = {"view": "found", "click": "matched", "purchase": "applied", "error": "ignored", "signup": "snoozed"}
STAGE_OF_ORDER = {"O": "score", "F": "enrich", "P": "dispatch"}

#: Surface forms and what normalising them gives; # stands for the row's number.
COMPANY_FORMS = [
    ("Acme # Corp., Inc.", "acme #"), ("The Acme# Corporation", "acme#"), ("Acme# B.V.", "acme#"), ("Acme# (Remote)", "acme#"), ("Booking#.com B.V.", "booking#"),
    ("Zürich# Insurance", "zurich# insurance"), ("AB Initio #", "ab initio #"), ("Inc", "inc"), (None, ""),
]
TITLE_FORMS = [
    ("Sr. Engineer #", "senior engineer #"), ("Front-End Engineer #", "frontend engineer #"), ("Node.js Developer #", "nodejs developer #"), ("Senior Engineer # (m/w/d)", "senior engineer #"),
    ("Contract Manager #", "contract manager #"), ("Remote", "remote"), ("", ""), ("Backend Engineer # - Remote, Europe", "backend engineer #"), ("Full Stack Developer # | Contract", "fullstack developer #"),
]
LOCATION_FORMS = [
    ("London, UK", "uk"), ("Cambridge, MA", "us"), ("Toronto, ON, Canada", "ca"), ("Greater London Area", "uk"), ("Europe Only", "eu"), ("N/A", "unknown"), ("Reykjavik", "reykjavik"),
    ("Berlin", "de"), ("Remote - US", "remote"), ("", "unknown"), (None, "unknown"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, values: list[str | None]) -> Column:
    """values[number mod their count]."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (number % len(values)).cast("int"))


def pick_sql(number: str, values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {number} % {len(values)} {cases} END"


def quoted(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def form(number: Column, forms: list[tuple[str | None, str]]) -> Column:
    """The surface form for a number, with the number in it."""
    return F.replace(pick(number, [f[0] for f in forms]), F.lit("#"), number.cast("string"))


def form_sql(number: str, forms: list[tuple[str | None, str]], side: int) -> str:
    return f"replace({pick_sql(number, [f[side] for f in forms])}, '#', CAST({number} AS VARCHAR))"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 7 != 0, day).alias("posted_at"), F.when(key % 35 != 0, day + F.expr("INTERVAL 2 DAYS")).alias("fetched_at"),
        pick(customer, TITLES).alias("title"), F.concat(F.lit("cust "), customer.cast("string")).alias("company"), pick(key, DESCRIPTIONS).alias("description"),
        F.array().cast("array<string>").alias("tags"), (key % 9 == 0).alias("sparse"), pick(key, ARRANGEMENTS).alias("arrangement"), pick(key, ELIGIBILITY).alias("geo_eligibility"),
        F.when(key % 4 == 0, F.array(F.lit("us"), F.lit("eu"))).otherwise(F.array().cast("array<string>")).alias("geo_regions"),
        F.when(customer % 3 == 1, 2).when(customer % 3 == 2, 8).alias("min_years"), F.when(customer % 3 == 1, 5).alias("max_years"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("price"), (key % 6).cast("int").alias("attempts"),
    )


POOL_SQL = f"""pool AS (
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS posted_at, CASE WHEN o_orderkey % 35 <> 0 THEN o_orderdate + INTERVAL 2 DAY END AS fetched_at,
        {pick_sql("o_custkey", TITLES)} AS title, o_custkey % {len(TITLES)} AS title_no, 'cust ' || o_custkey AS company, {pick_sql("o_orderkey", DESCRIPTIONS)} AS description,
        o_orderkey % 9 = 0 AS sparse, {pick_sql("o_orderkey", ARRANGEMENTS)} AS arrangement, {pick_sql("o_orderkey", ELIGIBILITY)} AS geo_eligibility,
        CASE o_custkey % 3 WHEN 1 THEN 2 WHEN 2 THEN 8 END AS min_years, CASE o_custkey % 3 WHEN 1 THEN 5 END AS max_years, o_orderstatus AS order_status, o_totalprice AS price, o_orderkey % 6 AS attempts
    FROM orders)"""


def viewer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair])
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("job_id"), F.try_element_at(statuses, F.col("event_type")).alias("status"))


STATE_SQL = "state AS (SELECT user_id, event_id AS job_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF_EVENT.items()) + " END AS status FROM events)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with the state of the stage machine."""
    stages = F.create_map(*[F.lit(x) for pair in STAGE_OF_ORDER.items() for x in pair])
    due = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.col("posted_at")).otherwise(F.lit(NOW) + F.expr("INTERVAL 1 DAY"))
    return pool(spark, sf_dir).withColumns({"stage": F.try_element_at(stages, F.col("order_status")), "status": pick(F.col("id"), ["found", "matched", "rejected", "found", "ignored"]), "next_attempt_at": due.cast("timestamp")})


QUEUE_SQL = POOL_SQL + f""", queue AS (
    SELECT *, CASE order_status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF_ORDER.items())} END AS stage, {pick_sql("id", ["found", "matched", "rejected", "found", "ignored"])} AS status,
        CASE id % 3 WHEN 1 THEN posted_at WHEN 2 THEN TIMESTAMP '{NOW}' + INTERVAL 1 DAY END AS next_attempt_at FROM pool)"""


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: noisy ids, the turn before as what even turns answer, all earlier turns as references."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")

    def name(t: Column) -> Column:
        return F.concat(F.lit("c"), conv, F.lit(".t"), t.cast("string"), F.lit("@x"))

    own = F.when(turn % 2 == 0, F.concat(F.lit("<"), name(turn), F.lit(">"))).otherwise(F.concat(F.lit(" <<"), F.upper(name(turn)), F.lit(">> ")))
    earlier = F.when(turn > 0, F.transform(F.sequence(F.lit(0).cast("long"), turn - 1), name)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", (F.col("conv_id") * 1000 + turn).alias("ord"), own.alias("message_id"), F.when((turn % 4 == 2), name(turn - 1)).alias("in_reply_to"),
        F.when(turn % 4 != 0, earlier).otherwise(F.array().cast("array<string>")).alias("references"), F.concat(F.lit("Person <P"), conv, F.lit("@X.org>")).alias("address"),
    )
