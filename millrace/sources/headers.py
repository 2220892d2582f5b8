"""A policy for reading mail that parses each different header once, as most values come again and again."""

from __future__ import annotations

import re
from email.policy import EmailPolicy, default
from functools import lru_cache

#: Headers of free text, and those that hold an id; values of which the parser gives back every character.
_FREE, _PLAIN = frozenset(("subject",)), re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9 .,:;()/_#+-]*[A-Za-z0-9])?")
_IDS, _ID = frozenset(("message-id",)), re.compile(r"<[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*>")


@lru_cache(1 << 13)
def _parsed(name: str, value: str) -> str:
    return default.header_fetch_parse(name, value)


class _Policy(EmailPolicy):
    """email.policy.default for reading: subjects and ids of plain characters are strings as they are."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        if hasattr(value, "name"):
            return value
        kind = name.lower()
        if kind in _FREE and _PLAIN.fullmatch(value) or kind in _IDS and _ID.fullmatch(value):
            return value
        return _parsed(name, value)


POLICY = _Policy()
