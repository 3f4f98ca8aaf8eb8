"""The state of one part of a user: its last panes and the ids met. See ``keyed``."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Context, Decimal

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

# Sums are exact; one with more than 20 digits before the point can't be held and counts as lost.
EXACT, LIMIT = Context(prec=80), Decimal(10) ** 20


class TrailingPanes(StatefulProcessor):
    """Adds up a part's panes of ``slide`` seconds and gives out the last ``kept`` of them.

    The state is one value, so that a key costs one read and one write however many
    panes it has: the newest pane, and by pane the number of events and of amounts, the
    sum as text, the amounts a sum can't hold, the largest amount and the ids.
    """

    def __init__(self, slide: int, kept: int) -> None:
        self.slide, self.kept = slide, kept

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "newest bigint, panes string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        # The first pane that the watermark has not passed.
        first = mark // (self.slide * 1000)
        before, text = self.held.get() or (None, "{}")
        held = {int(p): [*own[:5], dict.fromkeys(own[5])] for p, own in json.loads(text).items()}
        # As ``keyed.user_panes`` selects them.
        for _, _, pane, transaction, amount, exact, _ in rows:
            if pane < first:
                continue
            own = held.get(pane)
            if own is None:
                own = held[pane] = [0, 0, None, 0, None, {}]
            if transaction in own[5]:
                continue
            own[5][transaction] = None
            own[0] += 1
            if amount is not None:
                own[1] += 1
                own[4] = amount if own[4] is None else larger(own[4], amount)
                if exact is None:
                    own[3] += 1
                else:
                    # Text until the first amount of the batch comes.
                    own[2] = EXACT.add(Decimal(own[2] or 0), exact)
        if not held:
            return
        newest = max(held)
        # Neither does the trailing window need the others, nor can their ids come again.
        held = {
            p: [own[0], own[1], None if own[2] is None else str(own[2]), own[3], own[4], list(own[5])]
            for p, own in sorted(held.items()) if p > newest - self.kept or p >= first}
        self.held.update((newest, json.dumps(held)))
        if newest != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before + self.kept))
            self.handle.registerTimer(self._end(newest + self.kept))
        shown = [pane_fields(p, own) for p, own in held.items() if p > newest - self.kept]
        yield Row(user_id=key[0], split=key[1], panes=json.dumps(shown))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The watermark has passed all that could change or repeat what is held."""
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _end(self, pane: int) -> int:
        """When a pane ends, in milliseconds."""
        return (pane + 1) * self.slide * 1000


def pane_fields(pane: int, own: list) -> dict:
    total, lost = own[2], own[3]
    if total is not None and abs(Decimal(total)) >= LIMIT:
        total, lost = None, lost + 1
    return {"pane": pane, "n": own[0], "n_amounts": own[1], "total": total, "lost": lost, "largest": own[4]}


def larger(a: float, b: float) -> float:
    """The larger one, NaN above all as in the aggregation on tables."""
    return a if a != a or a > b else b
