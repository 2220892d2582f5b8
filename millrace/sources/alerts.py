"""Postings from alert e-mails: a mailbox scan, an outline of each message, and each sender's layout as Column rules.

Mail is read as binary files and cut to the sender, window and subject before any HTML is parsed. Python turns a message
into an outline once: its lines, its links, and the lines of the table cells that the links stand in. What is a
posting, a company, a place or a badge is told by expressions over these arrays, with the lines before and after at hand.
"""

from __future__ import annotations

import email
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import facts, text
from millrace.functions.text import BADGE_LINE, let
from millrace.ship import ship
from millrace.sources.feeds import POSTING, first_of_each, records
from millrace.sources.headers import POLICY
from millrace.sources.markup import Node, tree

# Links, and lines that are no postings, companies or places.
CARD_LINK = r"(?i)linkedin\.com/(?:comm/)?jobs/view/(\d+)"
CELL_LINK = "(?i)[?&]jk=([a-f0-9]+)"
MORE_OF = r"(?:see|view|show)\s+(?:all|more|this job|jobs|job)(?![A-Za-z0-9_]).*"
BUTTONS = (
    "apply|apply now|easy apply|apply on company website|unsubscribe|manage|manage alerts|manage job alerts|manage email preferences|settings|email settings|help|help center|linkedin|linkedin corporation|see all|view all|view job|see more"
    r"|show more|new jobs?|\d+ new jobs?|view \d+ new jobs?"
)
ARROWS = r"[\s>›»→•·|]+$"
ABOUT_PEOPLE = r"(?i)\bapplicants?\b|\bconnections?\b|\balumni\b|actively (?:recruiting|reviewing)|easy apply|\bpromoted\b|\breposted\b|\d+\s*(?:minute|hour|day|week|month)s?\s+ago"
RATING, EASY, PAY = r"^\d(?:\.\d)?$", r"(?i)^easily apply$", r"[₹$€£]\s?[\d,]"
POSTED = r"(?i)^(?:just posted|today|yesterday|active \d+\+? days? ago|\d+\+? days? ago|hiring ongoing|posted \d+)"
COMPANY_SIZE = r"(?i)\s*/\s*[\d,]+\s*-?\s*[\d,]*\+?\s*employees\s*$"
NO_TITLE = "(?i)^(?:ready to interview|open to offers|closed to offers|actively hiring|growing fast|learn more|hi|view all|unsubscribe)$"
YEARS, KIND, MONEY = r"(?i)(\d{1,2})\+?\s*years?\s+of\s+exp", r"(?i)^(?:(?:full|part)-time|contract|internship|co-?op)$", "[₹$€£]"
LONGEST_FIELD, LONGEST_PLACE = 80, 60

#: A message's outline. A link has the numbers of its cell and row, whose links are below it; lines have each text of a cell, whole those of links in one.
OUTLINE = "struct<lines:array<string>,links:array<struct<href:string,text:string,cell:int,row:int>>,cells:array<struct<lines:array<string>,whole:array<string>>>,rows:array<array<int>>>"
_LINK = pa.struct([("href", pa.string()), ("text", pa.string()), ("cell", pa.int32()), ("row", pa.int32())])
_CELL = pa.struct([("lines", pa.list_(pa.string())), ("whole", pa.list_(pa.string()))])
_OUTLINE = pa.struct([("lines", pa.list_(pa.string())), ("links", pa.list_(_LINK)), ("cells", pa.list_(_CELL)), ("rows", pa.list_(pa.list_(pa.int32())))])


class _Numbers(dict):
    """Numbers of elements in the order in which they are asked for."""

    def of(self, node: Node | None) -> int | None:
        return None if node is None else self.setdefault(node, len(self))


def outline(html: str) -> dict:
    """What OUTLINE describes. A cell is the nearest table cell, row or table around a link, a row the nearest row or table."""
    root = tree(html)
    links, cells, rows = list(root.all("a")), _Numbers(), _Numbers()
    place = {a: i for i, a in enumerate(links)}
    told = [{"href": a.attrs.get("href", ""), "text": a.squeezed(), "cell": cells.of(a.closest("td", "tr", "table")), "row": rows.of(a.closest("tr", "table"))} for a in links]
    return {"lines": root.lines(), "links": told, "cells": [{"lines": c.lines(), "whole": c.lines(("a", "img"))} for c in cells], "rows": [[place[a] for a in r.all("a")] for r in rows]}


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found, errors = [], []
            for html in part.column(part.num_columns - 1).to_pylist():
                try:
                    found.append(outline(html or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad message never stops a scan, and is counted
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.record_batch([*part.columns[:-1], pa.array(found, _OUTLINE), pa.array(errors, pa.string())], [*part.schema.names[:-1], "outline", "error"])


def outlined(mail: DataFrame) -> DataFrame:
    """(payload, date, outline, error) of messages; one that cannot be parsed has an error and no outline.

    Messages are dealt over as many tasks as a shuffle has, however few the files or row groups that they come from.
    """
    ship(mail.sparkSession)
    tasks = int(mail.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mail.select("payload", "date", "html").repartition(tasks, "payload", "date").mapInArrow(_outlines, f"payload string, date timestamp, outline {OUTLINE}, error string")


def is_navigation(line: Column) -> Column:
    """Whether a line or link leads to other pages; arrows at its end don't count."""
    return let(F.trim(F.regexp_replace(line, ARROWS, "")), lambda plain: (plain == "") | plain.rlike(rf"(?is)^(?:{MORE_OF})\z") | plain.rlike(rf"(?i)^(?:{BUTTONS})\z"))


def _is_badge(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, ARROWS, "")).rlike(rf"(?i)^(?:{BADGE_LINE})\z")


def _first(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def _last(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(values, test), F.lit(-1))


def _field(line: Column) -> Column:
    """A line that may be a company or a place."""
    return F.when((F.length(line) <= LONGEST_FIELD) & ~line.rlike(ABOUT_PEOPLE), line)


def card_postings(outlines: DataFrame) -> DataFrame:
    """Mails of cards. The links of one number are one posting, told by the longest of them.

    A card that is one link holds all that is known, and the shortest link is its title; else the lines after the link say
    who and where.
    """
    each = outlines.select("payload", "date", "outline", F.posexplode("outline.links").alias("at", "link")).withColumn("id", F.regexp_extract("link.href", CARD_LINK, 1)).filter((F.col("id") != "") & ~is_navigation(F.col("link.text")))
    cell = F.get("outline.cells", F.col("link.cell"))["whole"]
    siblings = F.transform(F.get("outline.rows", F.col("link.row")), lambda i: F.get("outline.links", i))
    linked = F.get(F.transform(F.filter(siblings, lambda x: F.contains(x["href"], F.lit("linkedin.com/company/"))), lambda x: x["text"]), F.lit(0))
    shape = F.struct(F.col("link.text").alias("text"), cell.alias("whole"), linked.alias("linked"))
    # from an array of one, so that what is sorted by mail and number holds a card and not the whole outline
    each = each.select("payload", "date", "at", "id", F.explode(F.array(shape)).alias("shape"))
    shape, size = F.col("shape"), F.length("shape.text")
    cards = each.groupBy("payload", "date", "id").agg(
        F.min("at").alias("pos"), F.max_by(shape, F.struct(size, -F.col("at"))).alias("card"), F.min_by("shape.text", F.struct(size, "at")).alias("shortest"), F.count("*").alias("n"), F.bool_or(F.contains("shape.text", F.lit(text.CARD_SEPARATOR))).alias("parted"),
    )
    own = cards.withColumn("told", text.repair_card(F.col("card.text"))).withColumn("one", (F.col("n") > 1) & F.col("parted"))
    # a card in one link
    title = F.col("shortest")
    rest = F.when(F.startswith(F.lower("told.title"), F.lower(title)), F.trim(F.substring(F.col("told.title"), F.length(title) + 1, F.length("told.title"))))
    in_link = F.coalesce(F.nullif("card.linked", F.lit("")), F.nullif(rest, F.lit("")))
    # a card of lines
    begin = F.array_position("card.whole", F.col("card.text")).cast("int")
    after = F.when(begin > 0, F.filter(F.slice("card.whole", begin + 1, F.size("card.whole")), lambda x: ~is_navigation(x) & ~_is_badge(x)))
    beside = _field(F.get(after, F.lit(0)))
    second = F.when(beside.isNotNull(), _field(F.get(after, F.lit(1))))
    easy = F.col("told.easy_apply") | (~F.col("one") & F.coalesce(F.exists("card.whole", lambda x: x.rlike(r"(?i)\beasy apply\b")), F.lit(False)))
    place = F.coalesce("told.location", F.when(~F.col("one"), second))
    return own.select(
        "payload", "pos", "date", "id", F.when(F.col("one"), title).otherwise(F.col("told.title")).alias("title"), F.coalesce(F.when(F.col("one"), in_link).otherwise(beside), F.lit("Unknown")).alias("company"), place.alias("location"),
        place.alias("stated"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "id", F.lit("/")).alias("url"), easy.alias("easy_apply"),
    )


def cell_postings(outlines: DataFrame) -> DataFrame:
    """Mails of table cells: a title, a company, and lines that are told apart by their form."""
    each = outlines.select("payload", "date", F.posexplode("outline.links").alias("pos", "link"), "outline.cells").withColumn("id", F.regexp_extract("link.href", CELL_LINK, 1)).filter("id != ''")
    lines = each.withColumn("lines", F.get("cells", F.col("link.cell"))["lines"]).filter(F.size("lines") >= 2)
    title, company = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    said = F.filter(F.slice("lines", 3, F.size("lines")), lambda x: ~x.rlike(RATING) & ~x.rlike(EASY))
    short = F.filter(said, lambda x: (F.length(x) <= LONGEST_PLACE) & ~x.rlike(POSTED))
    found = lines.filter(~title.rlike(RATING) & ~company.rlike(RATING)).select(
        "payload", "pos", "date", "id", title.alias("title"), company.alias("company"), _first(short, lambda x: ~x.rlike(PAY)).alias("location"), F.concat(F.lit("https://in.indeed.com/viewjob?jk="), "id").alias("url"),
        _first(said, lambda x: F.length(x) > LONGEST_PLACE).alias("description"), _first(short, lambda x: x.rlike(PAY)).alias("salary_text"), F.exists(F.slice("lines", 3, F.size("lines")), lambda x: x.rlike(EASY)).alias("easy_apply"),
    )
    return found.withColumn("stated", F.col("location"))


def stated_facts(line: Column) -> Column:
    """struct(min_years, salary_text, stated, location) of a line of segments between bars, each told by its form; of several alike the last counts."""
    def told(parts: Column) -> Column:
        other = F.filter(parts, lambda p: ~p.rlike(YEARS) & ~p.rlike(KIND))
        where = _last(other, lambda p: ~p.rlike(MONEY))
        comma = F.instr(where, ",")
        stated = F.trim(F.when(comma > 0, F.substring(where, F.lit(1), comma - 1)).otherwise(where))
        years = F.regexp_extract(_last(parts, lambda p: p.rlike(YEARS)), YEARS, 1).cast("int")
        return F.struct(
            years.alias("min_years"), _last(other, lambda p: p.rlike(MONEY)).alias("salary_text"), F.when(stated.rlike(r"(?i)^onsite or remote\b"), "remote").otherwise(stated).alias("stated"),
            F.when(comma > 0, F.trim(F.substring(where, comma + 1, F.length(where)))).alias("location"),
        )

    return let(F.filter(F.transform(F.split(line, r"\|", -1), lambda p: F.trim(p)), lambda p: p != ""), told)


def line_postings(outlines: DataFrame) -> DataFrame:
    """Mails of lines: a line that ends in a number of employees names the company; the line before it is the title, and one of the three after it the facts."""
    links = F.transform(F.filter("outline.links", lambda a: (a["text"] == "Learn More") & (a["href"] != "")), lambda a: a["href"])
    each = outlines.select("payload", "date", links.alias("more"), F.col("outline.lines").alias("lines"))
    slug = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")

    def seen(line: Column, i: Column) -> Column:
        company, title = F.trim(F.regexp_replace(line, COMPANY_SIZE, "")), F.get("lines", i - 1)
        told = _first(F.slice("lines", i + 2, 3), lambda x: F.contains(x, F.lit("|")) & x.rlike("(?i)years? of exp|remote|onsite|hybrid"))
        return F.when(line.rlike(COMPANY_SIZE) & (i > 0) & (company != "") & ~title.rlike(NO_TITLE), F.struct(F.concat_ws(":", slug(company), slug(title)).alias("id"), title.alias("title"), company.alias("company"), told.alias("told")))

    jobs = each.withColumn("jobs", F.array_compact(F.transform("lines", seen))).withColumn("ids", F.array_distinct(F.transform("jobs", lambda j: j["id"])))
    rows = jobs.select("payload", "date", "more", "ids", "jobs", F.posexplode("jobs").alias("pos", "j")).filter(F.array_position(F.transform("jobs", lambda j: j["id"]), F.col("j.id")) == F.col("pos") + 1)
    url = F.coalesce(F.get("more", (F.array_position("ids", F.col("j.id")) - 1).cast("int")), F.lit("https://wellfound.com/jobs"))
    return rows.withColumn("f", stated_facts(F.col("j.told"))).select("payload", "pos", "date", "j.id", "j.title", "j.company", "f.location", "f.stated", url.alias("url"), "f.salary_text", "f.min_years")


@dataclass(frozen=True)
class AlertSource:
    """subject: a pattern that the subject must have, or null; days: how far back to look; find: postings from outlines."""

    name: str
    domain: str
    days: int
    subject: str | None
    find: Callable[[DataFrame], DataFrame]
    tags: tuple[str, ...]


# The known senders.
LINKEDIN = AlertSource("linkedin_alert", "linkedin.com", 3, None, card_postings, ("linkedin-alert",))
WELLFOUND = AlertSource("wellfound_alert", "wellfound.com", 7, r"(?i)^new jobs:", line_postings, ("wellfound-alert",))
INDEED = AlertSource("indeed_alert", "indeed.com", 3, r"(?i)^apply to jobs(?![A-Za-z0-9_])|@", cell_postings, ("indeed-alert",))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                mail = email.message_from_bytes(content or b"", policy=POLICY)
                if not mail.items():
                    raise ValueError("no headers")
                body = mail.get_body(("html", "plain"))
                html = body.get_content() if body is not None else ""
                if body is not None and body.get_content_type() == "text/plain":
                    html = f"<pre>{html}</pre>"
                date = mail["date"].datetime.timestamp() if mail["date"] is not None and mail["date"].datetime else None
                headers = [(k, str(v)) for k, v in mail.items()]
                out.append((name, str(mail["message-id"] or ""), str(mail["from"] or ""), str(mail["subject"] or ""), date, html, list(dict(headers).items()), None))
            except Exception as e:  # noqa: BLE001  one bad message never stops a scan, and is counted
                out.append((name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = [*[pa.string()] * 4, pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["payload", "message_id", "sender", "subject", "at", "html", "headers", "error"])


def read_messages(files: DataFrame) -> DataFrame:
    """(payload, message_id, sender, subject, date, html, headers, error) of rows (path, content): a row for each; one that is no message has its error and nothing else."""
    ship(files.sparkSession)
    rows = files.select("path", "content").mapInArrow(_read, "payload string, message_id string, sender string, subject string, at double, html string, headers map<string,string>, error string")
    return rows.withColumn("date", F.timestamp_seconds("at")).select("payload", "message_id", "sender", "subject", "html", "headers", "date", "error")


def parse_mail(files: DataFrame) -> DataFrame:
    """The messages that read_messages() could read, without error."""
    return read_messages(files).filter("error is null").drop("error")


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """The messages of every file below a folder."""
    return parse_mail(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def wanted_mail(mail: DataFrame, source: AlertSource, now: datetime) -> DataFrame:
    """The messages of a sender in its window, with its subject."""
    wanted = (F.col("date") >= F.lit(now - timedelta(days=source.days))) & F.lower("sender").contains(source.domain)
    return mail.filter(wanted & F.trim("subject").rlike(source.subject) if source.subject else wanted)


def alert_failures(mail: DataFrame, source: AlertSource, now: datetime) -> DataFrame:
    """(payload, error) of the wanted messages that could not be parsed, and of those that gave no posting (error `no postings`)."""
    outlines = outlined(wanted_mail(mail, source, now))
    found = source.find(outlines.filter("error is null")).select("payload").distinct()
    return outlines.join(found, "payload", "left_anti").select("payload", F.coalesce("error", F.lit("no postings")).alias("error"))


def alert_postings(mail: DataFrame, source: AlertSource, now: datetime) -> DataFrame:
    """Postings of the messages of one sender in its window, the first of each id. Messages that give none are told by alert_failures()."""
    found = source.find(outlined(wanted_mail(mail, source, now)).filter("error is null"))
    rows = found.select(*found.columns, *[F.lit(None).cast(kind).alias(c) for c, kind in (("description", "string"), ("salary_text", "string"), ("min_years", "int"), ("easy_apply", "boolean")) if c not in found.columns])
    how = facts.arrangement(F.col("stated"), F.array().cast("array<string>"), F.lit(None).cast("boolean"))
    return records(
        first_of_each(rows, F.col("id")), POSTING, source=source.name, source_id=F.col("id"), title=F.col("title"), company=F.col("company"), url=F.col("url"), location=F.col("location"), arrangement=how,
        easy_apply=F.col("easy_apply"), remote=text.remote_of(how), min_years=F.col("min_years"), salary_text=F.col("salary_text"), description=F.col("description"), posted_at=F.col("date"),
        tags=F.array(*map(F.lit, source.tags)), sparse=F.coalesce(F.col("description"), F.lit("")) == "",
    )
