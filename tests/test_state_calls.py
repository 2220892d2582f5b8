"""Processors with state take plain rows and ask for the state of a key once: every call crosses to another process."""

from __future__ import annotations

from datetime import timedelta

from millrace.streaming import retries, watch


class Handle:
    """Counts what a processor asks of its state."""

    def __init__(self) -> None:
        self.calls, self.values = [], {}

    def getValueState(self, name, schema):
        return Value(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls.append("timer")

    deleteTimer = registerTimer


class Value:
    def __init__(self, handle, name) -> None:
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls.append(f"get {self.name}")
        return self.handle.values.get(self.name, () if self.name == "waiting" else None)

    def update(self, value):
        self.handle.calls.append(f"put {self.name}")
        self.handle.values[self.name] = value

    def appendList(self, values):
        self.handle.calls.append(f"put {self.name}")
        self.handle.values[self.name] = [*self.handle.values.get(self.name, ()), *values]


def test_a_failure_takes_three_calls():
    handle, processor = Handle(), retries.Retrier(5, False)
    processor.init(handle)
    out = list(processor.handleInputRows((17,), iter([{"ms": 5000, "kind": "failed", "error": "x"}]), None))
    assert handle.calls == ["get row", "put row", "timer"]
    assert out[0].asDict() == {"id": 17, "change": "waiting", "attempts": 1, "at": 5000, "due": 65000, "error": "x"}


def test_messages_of_a_key_take_seven_calls():
    handle, processor = Handle(), watch.Matcher(timedelta(days=1))
    processor.init(handle)
    rows = [{"ms": 9, "sent": False, "ord": 4, "rule": 1, "place": 0}, {"ms": 7, "sent": True, "ord": 3, "rule": 0, "place": 0}]
    out = [r.asDict() for r in processor.handleInputRows(("id:a",), iter(rows), None)]
    assert out == [{"ord": 4, "rule": 1, "place": 0, "ref_ord": 3, "ms": 9}]
    assert sorted(handle.calls) == ["get first", "get last", "get waiting", "put first", "put last", "put waiting", "timer"]
