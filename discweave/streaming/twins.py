"""The two operators that carry state, as batch and as streaming plans with the same result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from discweave.sources.bytes import Reassembler

PACKETS = "stream string, packet_no int, packet binary"
PAGES = "stream string, seq long, page int"


def reassemble(payloads: DataFrame) -> DataFrame:
    """Packets of (stream, seq, payload), batch: each stream's payloads in order of seq."""
    def whole(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        assembler, out = Reassembler(), []
        for payload in rows.sort_values("seq")["payload"]:
            out += assembler.feed(bytes(payload))
        return pd.DataFrame({"stream": [keys[0]] * len(out), "packet_no": range(len(out)), "packet": out})

    return payloads.groupBy("stream").applyInPandas(whole, PACKETS)


def reassemble_stream(payloads: DataFrame) -> DataFrame:
    """The same on a stream whose seq grows from one micro-batch to the next: every packet that is
    complete leaves at once, the rest of the bytes is the state."""
    def advance(keys: tuple, frames, state: GroupState):
        rest, n = state.get if state.exists else (b"", 0)
        assembler, out = Reassembler(bytes(rest)), []
        for payload in pd.concat(list(frames)).sort_values("seq")["payload"]:
            out += assembler.feed(bytes(payload))
        state.update((bytes(assembler.rest), n + len(out)))
        yield pd.DataFrame({"stream": [keys[0]] * len(out), "packet_no": range(n, n + len(out)), "packet": out})

    return payloads.groupBy("stream").applyInPandasWithState(advance, PACKETS, "rest binary, n int", "append", GroupStateTimeout.NoTimeout)


def page_segments_stream(frames: DataFrame, threshold: float) -> DataFrame:
    """Page numbers of (stream, seq, frame): the state is the last frame and its page."""
    def advance(keys: tuple, parts, state: GroupState):
        last, page = state.get if state.exists else (None, 0)
        out = []
        for seq, frame in pd.concat(list(parts)).sort_values("seq")[["seq", "frame"]].itertuples(index=False):
            values = [float(v) for v in frame]
            if not last or sum(abs(a - b) for a, b in zip(values, last, strict=True)) / len(values) > threshold:
                page += 1
            last = values
            out.append((keys[0], seq, page))
        state.update((last, page))
        yield pd.DataFrame(out, columns=["stream", "seq", "page"])

    return frames.groupBy("stream").applyInPandasWithState(advance, PAGES, "frame array<double>, page int", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream or table: windows that close after ``gap`` without an event."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
