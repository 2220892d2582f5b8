"""The policy that keeps parsed headers, against the parser's own."""

from __future__ import annotations

import email
import email.policy
import random

from millrace.sources.headers import POLICY, _parsed

ODD = ["=?utf-8?q?caf=C3=A9?=", "a  b", "a=?b", " lead", "x\n folded", "Ann <a@b.c>", "é", "a,b;c", "(c) d", "a_b #1", "tab\tx", "9", "", "a."]


def told(raw: bytes, policy) -> tuple:
    try:
        mail = email.message_from_bytes(raw, policy=policy)
        return [(k, str(v)) for k, v in mail.items()], mail["date"] and mail["date"].datetime, mail.get_content_type()
    except Exception as e:  # noqa: BLE001  what the parser refuses is refused alike
        return type(e).__name__, str(e)


def test_headers_read_as_the_default_policy_reads_them():
    r, fine = random.Random(3), 0
    for _ in range(400):
        v = r.choice(ODD) + r.choice(["", " ", "x", ": y"]) + r.choice(ODD)
        name = f"<{r.choice(['12', 'a.b', 'a..b', '.a', 'x y', 'q-1'])}@{r.choice(['x', 'x.y', '[1]', 'x_y'])}>" + r.choice(["", " ", " z"])
        raw = f"Subject: {v}\nFrom: {r.choice([v, 'Ann'])} <q@w.e>\nMessage-ID: {name}\nDate: {r.choice(['Mon, 01 May 2024 12:00:00 +0200', 'bad', '1 May 24'])}\nContent-Type: {r.choice(['text/html; charset=utf-8', 'text/plain'])}\n\nbody\n".encode()
        for _ in range(2):
            want = told(raw, email.policy.default)
            assert told(raw, POLICY) == want, raw
            fine += len(want) == 3
    assert fine > 300


def test_a_header_that_comes_again_is_not_parsed_again():
    _parsed.cache_clear()
    for i in range(200):
        mail = email.message_from_bytes(f"Subject: no {i}\nMessage-ID: <{i}@x>\nFrom: Ann <ann@x.example>\nDate: Mon, 01 May 2024 12:00:00 +0200\n\nx\n".encode(), policy=POLICY)
        assert str(mail["subject"]) == f"no {i}" and mail["date"].datetime.day == 1 and mail.get_body(("plain",)) is not None
    assert _parsed.cache_info().misses <= 4
