"""The state of a unit is asked and told once for the rows of a micro-batch."""

from functools import partial

import pandas as pd

from unitlens.streaming.changes import UnitProcessor

HOUR = 3_600_000_000


class Kept:
    """A value or map state that counts how often it is asked or told."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, do, *args):
        self.calls += 1
        return do(*args)

    def __getattr__(self, name):
        held = self.__dict__["held"]
        acts = {"exists": lambda: bool(held), "get": lambda: held.get(()), "update": lambda value: held.update({(): value}),
                "containsKey": lambda k: k in held, "getValue": lambda k: held.get(k), "updateValue": lambda k, value: held.update({k: value})}
        return partial(self._call, acts[name])


class Timers:
    def __init__(self):
        self.set, self.calls = [], 0

    def listTimers(self):
        self.calls += 1
        return iter(self.set)

    def deleteTimer(self, at):
        self.calls += 1
        self.set.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.set.append(at)


def _processor(trusting=True):
    p = UnitProcessor(24, 72, 100, 0.02, trusting)
    p.handle, p.life, p.told = Timers(), Kept(), Kept()
    return p


def _rows(*given):
    return pd.DataFrame(given, columns=["at_us", "kind", "price", "n", "ok"])


def test_a_state_is_asked_and_told_once_for_a_key_however_many_its_rows():
    drops = [(i * HOUR, "", 10_000.0 - 300 * i, 1, False) for i in range(30)]
    p = _processor()
    (out,) = p.handleInputRows((7,), iter([_rows(*drops[15:]), _rows(*drops[:15])]), None)
    assert out["at_us"].tolist() == [i * HOUR for i in range(30)] and out["event"].tolist() == ["new"] + ["price_drop"] * 29
    assert [i for i, told in enumerate(out["alert"]) if told] == [0, 1, 25]
    assert p.told.held == {("new",): (0,), ("price_drop",): (25 * HOUR,)}
    assert p.told.calls <= 6 and p.handle.calls == 1
    (more,) = p.handleInputRows((7,), iter([_rows((40 * HOUR, "", None, 1, False), (48 * HOUR, "", 100.0, 2, False))]), None)
    assert more["alert"].tolist() == [False, False] and more["times_seen"].tolist() == [31, 33] and more["price"].isna().tolist() == [True, False]
    assert p.handle.set == [(48 + 72) * HOUR // 1000]


def test_outcomes_alone_are_kept():
    p = _processor(trusting=False)
    assert list(p.handleInputRows((7,), iter([_rows((5, "new", None, 1, True), (6, "new", None, 1, False))]), None)) == []
    p.handleInitialState((7,), pd.DataFrame({"kind": ["new", "price_drop"], "at_us": [3, 4]}), None)
    assert p.told.held == {("new",): (5,), ("price_drop",): (4,)} and not p.handle.set
