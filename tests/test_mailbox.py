"""The mailbox source: what filters leave out is not read, and rows are those of a scan of files."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringContains

from millrace.sources import alerts, mailbox


def message(i, day, sender="Ann <ann@x.example>", body="<p>hello</p>", kind="html"):
    return f"From: {sender}\nSubject: no {i}\nDate: Mon, {day:02} May 2024 12:00:00 +0200\nMessage-ID: <{i}@x>\nMIME-Version: 1.0\nContent-Type: text/{kind}; charset=utf-8\n\n{body}\n"


@pytest.fixture(scope="module")
def box(tmp_path_factory):
    top = tmp_path_factory.mktemp("box")
    for name in ("inbox", "alerts/old", "_hidden"):
        (top / name).mkdir(parents=True)
    (top / "inbox/a.eml").write_text(message(1, 6, body="é" * 100_000))
    (top / "inbox/b.eml").write_text(message(2, 20, kind="plain"))
    (top / "inbox/junk").write_bytes(b"\xff\xfe\x00")
    (top / "inbox/long.eml").write_text("X-Filler: " + "y" * 20_000 + "\n" + message(3, 21, "Bo <BO@Jobs.Example>"))
    (top / "_hidden/c.eml").write_text(message(9, 20))
    (top / "alerts/old/box.mbox").write_text("".join(f"From x\n{message(10 + i, 10 + i, body=f'text {i}' + chr(10) + '>From here')}\n" for i in range(5)))
    return top


def test_rows_are_those_of_a_scan(spark, box):
    got = {r["message_id"]: r for r in mailbox.read_mailbox(spark, f"file://{box}", files=2).collect()}
    scan = alerts.read_messages(spark.read.format("binaryFile").load(f"{box}/inbox"))
    want = {r["message_id"]: r for r in scan.collect()}
    for key, row in want.items():
        for c in ("sender", "subject", "date", "html"):
            assert got[key][c] == row[c], (key, c)
    assert set(got) - set(want) == {f"<{10 + i}@x>" for i in range(5)} and None in got and got[None]["error"]
    assert got["<10@x>"]["folder"] == "alerts/old" and got["<3@x>"]["domain"] == "jobs.example" and got["<12@x>"]["html"].split() == ["text", "2", "From", "here"]


def test_filters_reach_the_reader(spark, box):
    late = mailbox.read_mailbox(spark, f"file://{box}").filter((F.col("date") >= F.lit(datetime(2024, 5, 12))) & F.col("folder").isin("inbox", "alerts/old") & (F.col("domain") == "x.example") & F.col("html").contains("t"))
    assert sorted(r["message_id"] for r in late.collect()) == ["<12@x>", "<13@x>", "<14@x>"]
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and " IN " not in plan and "x.example" not in plan and "Contains(html" in plan
    assert mailbox.read_mailbox(spark, f"file://{box}").filter("folder = 'nowhere'").count() == 0


def test_bodies_outside_the_window_are_not_read(box):
    reader = mailbox.MailReader(f"file://{box}")
    other = StringContains(("html",), "x")
    since = datetime(2024, 5, 12).astimezone()
    assert list(reader.pushFilters([GreaterThanOrEqual(("date",), since), In(("folder",), ("inbox",)), other, EqualTo(("error",), "x")])) == [other, EqualTo(("error",), "x")]
    (part,) = reader.partitions()
    asked = []
    plain = reader._single
    reader._single = lambda stream, head: (lambda found: (found[0], lambda: asked.append(found[0]) or found[1]()))(plain(stream, head))
    assert [r[2] for r in reader.read(part)] == ["<2@x>", "<3@x>"]
    assert len(asked) == 2 and not any(b"<1@x>" in h for h in asked)


def test_large_files_of_a_folder_are_dealt_over_tasks(tmp_path, monkeypatch):
    from millrace.sources import mailbox

    (tmp_path / "in").mkdir()
    for i in range(7):
        (tmp_path / "in" / f"{i}.mbox").write_bytes(b"x" * (100 if i == 3 else 30))
    monkeypatch.setattr(mailbox, "BYTES", 64)
    parts = mailbox.MailReader(str(tmp_path)).partitions()
    assert [len(p.paths) for p in parts] == [2, 1, 1, 2, 1] and sorted(x for p in parts for x in p.paths) == sorted(str(p) for p in (tmp_path / "in").iterdir())
    assert [len(p.paths) for p in mailbox.MailReader(str(tmp_path), 1).partitions()] == [1] * 7
