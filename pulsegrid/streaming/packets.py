"""Fragments of packets put together as a stream, by sender, with a sequence number that counts modulo 256.

A sender's state is the number it is at, how often that has wrapped, and the fragments that have come of it. A packet
with another number ends what was held: incomplete frames are discarded and counted. A frame comes out when its last
fragment does, whatever their order, and the next number is awaited then. Packets are taken in order of arrival
within a micro-batch; a fragment of a wrong length is left out, one that comes twice replaces the first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WRAP = 256
FRAME = "addr {addr}, device {device}, frame long, seq int, payload binary, skipped long, discarded long"


class Sender:
    """seq: the awaited number; count: frames since the first number, wraps included; skipped: numbers passed over; discarded: frames left incomplete."""

    def __init__(self):
        self.seq, self.count, self.held = None, 0, {}
        self.skipped = self.discarded = 0

    def put(self, seq: int, fragment: int, payload: bytes, lengths: tuple[int, ...]) -> tuple[int, int, bytes] | None:
        if not 0 <= fragment < len(lengths) or len(payload) != lengths[fragment]:
            return None
        if self.seq is None:
            self.seq = seq
        if seq != self.seq:
            step = (seq - self.seq) % WRAP
            self.discarded += bool(self.held)
            self.skipped += step - bool(self.held)
            self.count += step
            self.seq, self.held = seq, {}
        self.held[fragment] = payload
        if len(self.held) < len(lengths):
            return None
        done = self.count, self.seq, b"".join(self.held[k] for k in range(len(lengths)))
        self.seq, self.count, self.held = (self.seq + 1) % WRAP, self.count + 1, {}
        return done


class _Frames(StatefulProcessor):
    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = lengths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sender", "sender binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sender: Sender = pickle.loads(self.state.get()[0]) if self.state.exists() else Sender()
        out = []
        for r in pd.concat(rows).sort_values("n").itertuples():
            if done := sender.put(int(r.seq), int(r.fragment), bytes(r.payload), self.lengths):
                out.append((*key, *done, sender.skipped, sender.discarded))
        self.state.update((pickle.dumps(sender),))
        yield pd.DataFrame(out, columns=["addr", "device", "frame", "seq", "payload", "skipped", "discarded"])


def frames(stream: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """stream: addr, device, n (order of arrival), seq (modulo 256), fragment (from 0), payload. lengths: bytes of each fragment.

    Per whole frame: addr, device, frame (counted on over wraps), seq, payload, and how many numbers were skipped and frames discarded so far.
    A gap of 256 numbers or more cannot be told from a shorter one.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("addr", "device")}
    return stream.groupBy("addr", "device").transformWithStateInPandas(_Frames(lengths), FRAME.format(**kinds), "Append", "None")
