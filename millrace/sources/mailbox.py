"""Mailboxes as a Spark data source: folders are partitions, and what a query asks of date, domain and folder is pushed to the reader.

The headers of a message are read first. A message that the pushed filters leave out is passed over from there: its body
is neither decoded nor parsed, and of a file with one message it is not even read. Paths are those that pyarrow opens.
"""

from __future__ import annotations

import email
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.parser import BytesHeaderParser

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from millrace.ship import ship
from millrace.sources.headers import POLICY

SCHEMA = "folder string, payload string, message_id string, sender string, domain string, subject string, date timestamp, html string, headers map<string,string>, error string"
#: Files of a folder that are read by one task, and bytes after which a task gets no more.
FILES, BYTES = 1000, 16 << 20
#: Bytes of a file that are read at a time while headers last.
STEP = 8192
_HOLDS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}
#: Columns that are known from the headers and the place of a message.
_EARLY = ("folder", "domain", "date", "sender", "subject", "message_id")


@dataclass
class Files(InputPartition):
    folder: str
    paths: list[str]


def _domain(sender: str) -> str:
    found = re.search(r"@([^\s>]+)", sender)
    return found[1].lower() if found else ""


def _early(folder: str, mail: email.message.Message) -> dict:
    when = mail["date"].datetime if mail["date"] is not None else None
    if when is not None:
        when = when.astimezone(UTC) if when.tzinfo else when.replace(tzinfo=UTC)
    sender = str(mail["from"] or "")
    return {"folder": folder, "domain": _domain(sender), "date": when, "sender": sender, "subject": str(mail["subject"] or ""), "message_id": str(mail["message-id"] or "")}


def _aware(value: object) -> object:
    """Times are compared in UTC; a pushed time without a zone is the machine's own, as Spark hands them over."""
    return value.astimezone(UTC) if isinstance(value, datetime) else value


class MailReader(DataSourceReader):
    def __init__(self, path: str, files: int = FILES) -> None:
        self.path, self.files, self.filters = path, files, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the filters on what headers tell; Spark applies the others itself."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _HOLDS and len(column) == 1 and column[0] in _EARLY:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, known: dict) -> bool:
        for f in self.filters:
            name = f.attribute[0]
            if name in known:
                value = known[name]
                other = tuple(map(_aware, f.value)) if isinstance(f, In) else _aware(f.value)
                if value is None or not _HOLDS[type(f)](value, other):
                    return False
        return True

    def partitions(self) -> list[Files]:
        """The files below each folder at the path, by folder; folders that the filters leave out are not listed further."""
        files, top = fs.FileSystem.from_uri(self.path)
        by_folder: dict[str, list[tuple[str, int]]] = {}
        for f in files.get_file_info(fs.FileSelector(top, recursive=True)):
            rest = f.path[len(top) :].strip("/").split("/")
            if f.is_file and not any(x.startswith((".", "_")) for x in rest):
                by_folder.setdefault("/".join(rest[:-1]), []).append((f.path, f.size or 0))
        return [Files(name, part) for name, paths in sorted(by_folder.items()) if self._wanted({"folder": name}) for part in self._parts(sorted(paths))] or [Files("", [])]

    def _parts(self, paths: list[tuple[str, int]]) -> Iterator[list[str]]:
        """Paths in runs of at most so many files, and of at most so many bytes if there is more than one."""
        part, held = [], 0
        for path, size in paths:
            if part and (len(part) == self.files or held + size > BYTES):
                yield part
                part, held = [], 0
            part.append(path)
            held += size
        if part:
            yield part

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                head = stream.read(STEP)
                messages = self._box(stream, head) if head.startswith(b"From ") else [self._single(stream, head)]
                for i, (head_bytes, body) in enumerate(messages):
                    name = path if len(messages) == 1 and not head.startswith(b"From ") else f"{path}#{i}"
                    yield from self._row(partition.folder, name, head_bytes, body)

    def _single(self, stream, head: bytes) -> tuple[bytes, object]:
        """(headers, a function that reads the rest)."""
        while not (end := re.search(rb"\r?\n\r?\n", head)) and (more := stream.read(STEP)):
            head += more
        cut = end.end() if end else len(head)
        return head[:cut], lambda: head[cut:] + stream.read()

    def _box(self, stream, head: bytes) -> list[tuple[bytes, object]]:
        """The messages of an mbox file, which is read as a whole; bodies are not looked into."""
        out = []
        for part in re.split(rb"(?m)^From [^\n]*\n", head + stream.read())[1:]:
            end = re.search(rb"\r?\n\r?\n", part)
            cut = end.end() if end else len(part)
            out.append((part[:cut], lambda part=part, cut=cut: re.sub(rb"(?m)^>(>*From )", rb"\1", part[cut:])))
        return out

    def _row(self, folder: str, name: str, head: bytes, body) -> Iterator[tuple]:
        try:
            headers = BytesHeaderParser(policy=POLICY).parsebytes(head)
            if not headers.items():
                raise ValueError("no headers")
            known = _early(folder, headers)
        except Exception as e:  # noqa: BLE001  one bad message never stops a scan, and is told
            if self._wanted({"folder": folder}) and all(f.attribute[0] == "folder" for f in self.filters):
                yield (folder, name, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])
            return
        if not self._wanted(known):
            return
        html, error = None, None
        try:
            mail = email.message_from_bytes(head + body(), policy=POLICY)
            part = mail.get_body(("html", "plain"))
            html = part.get_content() if part is not None else ""
            html = f"<pre>{html}</pre>" if part is not None and part.get_content_type() == "text/plain" else html
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
        yield (folder, name, known["message_id"], known["sender"], known["domain"], known["subject"], known["date"], html, {k: str(v) for k, v in headers.items()}, error)


class MailSource(DataSource):
    """spark.read.format("mailbox").load(uri): a row for each message of each file, single or mbox; error says why a message has no text."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(self.options["path"], int(self.options.get("files", FILES)))


def read_mailbox(spark: SparkSession, uri: str, files: int = FILES) -> DataFrame:
    """The messages of the mailbox at a URI. Filters on folder, domain, date, sender, subject and message_id reach the reader."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)
    return spark.read.format("mailbox").option("files", files).load(uri)
