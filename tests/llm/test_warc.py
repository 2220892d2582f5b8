from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest
from compare import assert_same, connect
from helpers import EDGE, SF, documents, prose
from pyspark.sql import functions as F

from millrace.llm.queries import QUERIES, SQL
from millrace.llm.warc import archived, base32_sha1, chunked, dechunked, parsed, read_warc, records_of, write_warc


SF_MORE = "/root/testdata/sf0.01"


def brute(rows, min_bytes=0):
    newest = {}
    for key, text in rows:
        if key is not None:
            newest[text or ""] = max(newest.get(text or "", key), key)
    out = Counter()
    for key, text in rows:
        data = (text or "").encode()
        first = newest.get(text or "") if len(data) >= min_bytes else None
        again = first is not None and key != first
        out[key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    return out


def got(df, id_col="doc_id"):
    return Counter(tuple(r) for r in df.select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ROWS = [*EDGE, (20, prose(9, 900)), (21, prose(9, 900)), (20, prose(9, 900)), (22, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (23, "0\r\n\r\n"), (24, None)]


@pytest.mark.parametrize(("segment", "files", "least"), [(1, 7, 0), (50, 3, 5), (1 << 20, 1000, 0)])
def test_rows_come_back(spark, segment, files, least):
    rows = [r for r in ROWS if segment > 1 or len(r[1] or "") < 100]
    docs = documents(spark, rows).withColumn("html", F.col("text")).withColumn("url", F.lit("x"))
    assert got(archived(docs, "doc_id", "source", "text", least, segment, files)) == brute(rows, least)


def test_query_matches_sql_and_has_segments(spark):
    assert_same(QUERIES["op12_warc"](spark, SF), SQL["op12_warc"], connect(SF))
    assert spark.read.parquet(f"{SF_MORE}/pages.parquet").filter(F.octet_length("html") > 16_384).count() > 0


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, "the same page" if i % 3 else f"page {i}") for i in range(3000)]
    assert got(archived(documents(spark, rows), "doc_id", "source", "text")) == brute(rows)


def test_empty_table_and_odd_headers(spark, tmp_path):
    none = documents(spark, [(1, "x")]).filter("doc_id = 2")
    assert archived(none, "doc_id", "source", "text").count() == 0
    odd = spark.createDataFrame([("a\r\nb%0D", "http://x/\r\nHost: y", "text"), ("", None, "text")], "key string, uri string, body string")
    write_warc(odd, f"file://{tmp_path}/odd", "key", "uri", "body")
    assert {(r.row, r.uri, r.type, r.status) for r in read_warc(spark, f"file://{tmp_path}/odd").collect()} == {("a\r\nb%0D", "http://x/\r\nHost: y", "response", "ok"), ("", None, "revisit", "ok")}
    with pytest.raises(ValueError):
        write_warc(odd, f"file://{tmp_path}/more", "key", "uri", "body", segment_bytes=0)


@pytest.mark.parametrize("size", [1, 3, 8192])
def test_chunk_framing(size):
    for body in (b"", b"abc", b"0\r\n\r\n" * 50, bytes(range(256)) * 40):
        framed = chunked(body, size)
        assert dechunked(framed) == body
        assert all(dechunked(framed[:n]) is None for n in range(0, len(framed) - 2, max(7, len(framed) // 50)))
    assert dechunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert dechunked(b"-1\r\n\r\n") is None and dechunked(b"zz\r\nab\r\n") is None


def test_parsing_goes_on_after_what_is_no_record():
    one = next(records_of("1", "u", b"payload", None, None, "d", 1 << 20, False)) + b"\r\n\r\n"
    data = one + b"rubbish\r\n\r\n" + one + one[:-30]
    assert [f is not None for f, _ in parsed(data)] == [True, False, True, False]


def test_faults_have_a_status(spark, tmp_path):
    """Segments in any order over plain and gzip files, of one or more members; each fault by name."""
    files = defaultdict(list)
    text = bytes(range(256)) * 8
    whole = {k: list(records_of(k, f"http://x/{k}", text + k.encode(), None, None, "d", 500, False)) for k in ("whole", "lost", "cut", "wrong", "twice")}
    for i, record in enumerate(reversed(whole["whole"])):
        files[f"w{i % 3}.warc"].append(record)
    files["a.warc"] += [r for i, r in enumerate(whole["lost"]) if i != 1]
    files["b.warc"] += [*whole["cut"][:-1], whole["cut"][-1].replace(b"Total-Length: ", b"Total-Length: 9")]
    files["c.warc"] += [whole["wrong"][0].replace(b"sha1:", b"sha1:AAAA"), *whole["wrong"][1:]]
    files["d.warc"] += whole["twice"] + whole["twice"]
    files["e.warc"] += records_of("frame", "u", b"abc", None, None, "d", 500, False)
    files["e.warc"][0] = files["e.warc"][0].replace(b"\r\n3\r\n", b"\r\n4\r\n")
    files["f.warc"] += records_of("again", "u", b"abc", "nowhere", "u", "d", 500, True)
    files["g.warc"] += [b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Segment-Number: 2\r\nContent-Length: 1\r\n\r\nx", b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n"]
    for name, records in files.items():
        body = [r + b"\r\n\r\n" for r in records]
        data = {"d.warc": b"".join(map(gzip.compress, body)), "b.warc": gzip.compress(b"".join(body))}.get(name, b"".join(body))
        (tmp_path / name).write_bytes(data)
    (tmp_path / "h.warc").write_bytes(gzip.compress(files["f.warc"][0] + b"\r\n\r\n")[:-4])
    found = read_warc(spark, f"file://{tmp_path}", payloads=True).collect()
    assert Counter((r.row, r.status) for r in found) == Counter({("whole", "ok"): 1, ("lost", "segments"): 1, ("cut", "length"): 1, ("wrong", "digest"): 1, ("twice", "ok"): 2, ("frame", "framing"): 1, ("again", "dangling"): 2, (None, "segments"): 1, (None, "ok"): 1, (None, "malformed"): 1})
    assert {bytes(r.payload) for r in found if r.payload and r.status == "ok"} == {text + b"whole", text + b"twice"}
    assert all(r.digest == base32_sha1(bytes(r.payload)) for r in found if r.payload)
