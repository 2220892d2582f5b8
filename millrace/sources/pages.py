"""Descriptions of fetched posting pages: structured data first, then known containers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import html_text, job_page_id
from millrace.operators.stages import enrich_outcome
from millrace.ship import ship
from millrace.sources.markup import Node, tree

#: Classes and ids of containers of a description, by preference.
CONTAINERS = [("class", "show-more-less-html__markup"), ("class", "description__text"), ("class", "jobs-description__content"), ("id", "job-details")]
ALL_TAGS = tuple("div section article span p ul li main td body".split())


def _nodes(value: object) -> Iterator[dict]:
    if isinstance(value, list):
        for v in value:
            yield from _nodes(v)
    elif isinstance(value, dict):
        yield value
        yield from _nodes(value.get("@graph"))


def _structured(root: Node) -> tuple[str | None, str | None]:
    """(description, company) of the first posting in the page's linked data that has either."""
    for script in root.all("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        for node in _nodes(data):
            kind = node.get("@type")
            if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
                organisation = node.get("hiringOrganization")
                name = organisation.get("name") if isinstance(organisation, dict) else None
                company = name.strip() or None if isinstance(name, str) else None
                text = node.get("description")
                if (isinstance(text, str) and text.strip()) or company:
                    return (text if isinstance(text, str) and text.strip() else None), company
    return None, None


def _markup(node: Node) -> str:
    """The inside of an element with only the tags that separate text."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif c.name not in ("script", "style"):
            out.append(f"<{c.name}>{_markup(c)}</{c.name}>" if c.name != "br" else "<br>")
    return "".join(out)


def find_description(html: str) -> tuple[str | None, str | None, str | None]:
    """(markup of the structured description, markup of the first container, company)."""
    root = tree(html)
    text, company = _structured(root)
    held = None
    for attribute, value in CONTAINERS:
        held = next((n for n in root.all(*ALL_TAGS) if value in n.attrs.get(attribute, "").split()), None)
        if held is not None and held.squeezed():
            break
    return text, _markup(held) if held is not None else None, company


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_description(h) if h and h.strip() else (None, None, None) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], *[pa.array(c, pa.string()) for c in (list(zip(*found, strict=True)) or [[]] * 3)]], [*batch.schema.names[:-1], "structured", "held", "company"])


def enrich_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", status_col: str = "http_status") -> DataFrame:
    """(url, job_id, http_status, outcome, description, company) of fetched pages. Markup that is escaped as a whole is decoded twice."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(url_col).alias("url"), F.col(status_col).cast("int").alias("http_status"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(_find, "url string, http_status int, structured string, held string, company string")

    def readable(markup):
        escaped = ~markup.rlike(r"(?i)</?[a-z][^>]*>") & markup.rlike(r"(?i)&lt;/?[a-z][^&]*&gt;")
        return F.nullif(F.when(escaped, html_text(html_text(markup))).otherwise(html_text(markup)), F.lit(""))

    text = F.coalesce(readable(F.col("structured")), readable(F.col("held")))
    outcome = enrich_outcome(F.col("http_status"), text)
    good = outcome.isin("ok", "not_found") & F.col("http_status").between(200, 299)
    return found.select("url", job_page_id(F.col("url")).alias("job_id"), "http_status", outcome.alias("outcome"), F.when(outcome == "ok", text).alias("description"), F.when(good, F.col("company")).alias("company"))
