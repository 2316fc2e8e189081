"""Filters on streams of text deltas: the answer policy and the refusal gate, as plain objects, over batches and streams.

A request's deltas come in order of seq; the row with kind `end` lets out what is held. A late delta after that is
against the contract, and an error.

The filter is a scanner that looks at each character once. It stands outside, or inside a construct that the policy may
remove, and knows how long the prefix is that nothing to come can change: up to the last break that it met outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.guard import POLICY, REFUSAL_TOKEN

OUT = "request_id string, seq int, delta string, images_removed int, links_removed int"
STATE = "gated boolean, ended boolean, text string, scanned int, settled int, inside string, images int, links int"

#: What opens a construct, and what closes it. Breaks inside one settle nothing.
CLOSES = {"![": ")", "<": ">"}
_EVENT = re.compile("|".join([*map(re.escape, CLOSES), "[ \\n]"]))
#: Texts that may become the token: a beginning of it, in white space and quotes, or all of it with full stops.
_QUOTES = "[`'\"]*"
_BEGINNING = re.compile(rf"\s*{_QUOTES}(?:{'(?:'.join(REFUSAL_TOKEN)}[.`'\"]*{')?' * len(REFUSAL_TOKEN)}{_QUOTES}\s*", re.IGNORECASE)


def policy(text: str) -> tuple[str, int, int]:
    """The text under the policy; images and tags removed; links and URLs removed."""
    counts = {"images": 0, "links": 0}
    for pattern, stand_in, kind in POLICY:
        text, n = re.subn(pattern, stand_in.replace("$", "\\"), text)
        counts[kind] += n
    return text, counts["images"], counts["links"]


class DeltaFilter:
    """The gate, then the policy. gate: hold text while it may still be the refusal token, and never show that.

    text is what is held; of it, scanned characters have been looked at, settled ones may go; inside is the opener of the
    construct that the scanner stands in, or nothing."""

    def __init__(self, gated: bool = True, ended: bool = False, text: str = "", scanned: int = 0, settled: int = 0, inside: str = "", images: int = 0, links: int = 0) -> None:
        self.gated, self.ended, self.text, self.scanned, self.settled, self.inside, self.images, self.links = gated, ended, text, scanned, settled, inside, images, links

    def state(self) -> tuple:
        return self.gated, self.ended, self.text, self.scanned, self.settled, self.inside, self.images, self.links

    def feed(self, delta: str) -> str:
        if self.ended:
            raise ValueError("a delta after the end of its request")
        self.text += delta
        if self.gated:
            self.gated = _BEGINNING.fullmatch(self.text) is not None
            if self.gated:
                return ""
        self._scan()
        return self._released(self.settled)

    def flush(self) -> str:
        """What is held, at the end of the request. A text that is the token, or began as it, is not shown."""
        self.ended = True
        return "" if self.gated else self._released(len(self.text))

    def _scan(self) -> None:
        while self.scanned < len(self.text):
            if self.inside:
                at = self.text.find(CLOSES[self.inside], self.scanned)
                self.scanned, self.inside = (len(self.text), self.inside) if at < 0 else (at + 1, "")
                continue
            event = _EVENT.search(self.text, self.scanned)
            if event is None:
                # The last character may be the first half of an opener.
                self.scanned = max(self.scanned, len(self.text) - 1)
                return
            self.scanned = event.end()
            if event.group() in CLOSES:
                self.inside = event.group()
            else:
                self.settled = event.end()

    def _released(self, n: int) -> str:
        out, self.text = self.text[:n], self.text[n:]
        self.scanned, self.settled = max(0, self.scanned - n), 0
        text, images, links = policy(out)
        self.images, self.links = self.images + images, self.links + links
        return text


def _filtered(request_id: str, rows: pd.DataFrame, own: DeltaFilter) -> pd.DataFrame:
    out = []
    for seq, kind, delta in zip(rows["seq"], rows["kind"], rows["delta"], strict=True):
        text = own.flush() if kind == "end" else own.feed(delta or "")
        out.append((request_id, int(seq), text, own.images, own.links))
    return pd.DataFrame(out, columns=["request_id", "seq", "delta", "images_removed", "links_removed"])


def filter_batch(deltas: DataFrame, gate: bool = True) -> DataFrame:
    """request_id, seq, delta and removals so far, for deltas: request_id, seq, kind (delta or end), delta."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _filtered(key[0], rows.sort_values("seq"), DeltaFilter(gate))

    return deltas.groupBy("request_id").applyInPandas(run, OUT)


def filter_stream(deltas: DataFrame, gate: bool = True) -> DataFrame:
    """The same on a streaming DataFrame; a request's state goes when it ends."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = DeltaFilter(*state.get) if state.exists else DeltaFilter(gate)
        rows = pd.concat(list(batches)).sort_values("seq")
        yield _filtered(key[0], rows, own)
        if own.ended:
            state.remove()
        else:
            state.update(own.state())

    return deltas.groupBy("request_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
