"""What one entity costs a micro-batch of the ordered stream: few calls to its state, and no event written twice."""

from pyspark.sql import Row

from tesserine.operators.effects import Rule, Tally
from tesserine.streaming.effects import EffectFold, folded


class Kept:
    """A state that counts its calls; a list where ``get`` iterates."""

    def __init__(self, many):
        self.many, self.value, self.calls, self.written = many, [] if many else None, 0, 0

    def get(self):
        self.calls += 1
        return iter(list(self.value)) if self.many else self.value

    def exists(self):
        self.calls += 1
        return bool(self.value)

    def _set(self, value, n):
        self.calls, self.value, self.written = self.calls + 1, value, self.written + n

    def update(self, value):
        self._set(value, 1)

    def put(self, rows):
        self._set(list(rows), len(rows))

    def appendList(self, rows):
        self._set([*self.value, *rows], len(rows))

    def clear(self):
        self._set([], 0)


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        self.settled = Kept(False)
        return self.settled

    def getListState(self, *_):
        self.waiting = Kept(True)
        return self.waiting

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def row(i):
    return Row(entity="a", created_at=100 + i, event=f"e{i:03}", m=1, weight=0.5, raw=[float(i), 1.0])


def test_waiting_events_are_written_once():
    rule, fold, handle = Rule(0.4, 10_000, floor=0.5), EffectFold(Rule(0.4, 10_000, floor=0.5)), Handle()
    fold.init(handle)
    parts = [[7, 3, 5], [1, 9, 3], [2, 8], [4, 6, 0]]  # out of order, one twice
    for n, part in enumerate(parts):
        before = handle.settled.calls + handle.waiting.calls
        out = list(fold.handleInputRows(("a",), iter(map(row, part)), Clock(0)))[0]
        assert handle.settled.calls + handle.waiting.calls - before <= 3
        have = sorted({i for p in parts[: n + 1] for i in p})
        tally = Tally()
        vec = folded(tally, None, [(r.created_at, r.m, r.weight, r.raw) for r in map(row, have)], rule)
        assert (out["count"], out.average, out.oldest, out.value) == (tally.count, tally.average, tally.oldest, vec.tolist())
    assert handle.waiting.written == 10 and handle.settled.written == 0
    list(fold.handleExpiredTimer(("a",), Clock(105_000), None))  # the first five settle
    assert handle.settled.value[0] == 5 and sorted(e[1] for e in handle.waiting.value) == [f"e{i:03}" for i in range(5, 10)]
    out = list(fold.handleInputRows(("a",), iter([row(10)]), Clock(10**9)))[0]
    assert out["count"] == 11 and not handle.waiting.value
