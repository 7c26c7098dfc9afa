"""Streams: placeholders restored across chunk borders, server-sent events split from chunks, idle sessions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vault import PLACEHOLDER

HOLD = 256
EVENT_LIMIT = 8 << 20


class Restorer:
    """Restores placeholders in text that comes in chunks.

    What follows the last unclosed `{{` (or is a trailing `{`) is held back, up to 256 characters; everything before
    is restored and passed on.
    """

    pattern = re.compile(PLACEHOLDER)

    def __init__(self, table: dict[str, str], held: str = "") -> None:
        self.table, self.held, self.replaced = table, held, 0

    def _swap(self, match: re.Match) -> str:
        value = self.table.get(match.group())
        if value is None:
            return match.group()
        self.replaced += 1
        return value

    def feed(self, chunk: str) -> str:
        text = self.held + chunk
        at = text.rfind("{{")
        if at < 0 or "}}" in text[at:]:
            at = len(text) - 1 if text.endswith("{") else len(text)
        if len(text) - at > HOLD:
            at = len(text)
        ready, self.held = text[:at], text[at:]
        return self.pattern.sub(self._swap, ready)

    def end(self) -> str:
        ready, self.held = self.held, ""
        return self.pattern.sub(self._swap, ready)


def restore_stream(chunks: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Restored text of a stream of chunks (stream_id, block, seq, chunk, last[, vault]) by stream and block.

    The state of a block is its held text and its count; it goes when the last chunk has come. ``vault`` is a map
    column of placeholders to values; ``table`` is for tests and small sessions.
    """
    has_vault = "vault" in chunks.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, replaced = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        known = dict(table or {})
        if has_vault:
            for v in rows["vault"]:
                known.update(dict(v) if v is not None else {})
        restorer = Restorer(known, held)
        out, ended = [], False
        for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["last"]):
            text = restorer.feed(chunk)
            if last:
                text += restorer.end()
                ended = True
            out.append((*key, seq, text, replaced + restorer.replaced))
        if ended:
            state.remove()
        else:
            state.update((restorer.held, replaced + restorer.replaced))
        yield pd.DataFrame(out, columns=["stream_id", "block", "seq", "restored", "replacements"])

    return chunks.groupBy("stream_id", "block").applyInPandasWithState(
        step, "stream_id string, block int, seq long, restored string, replacements long", "held string, replaced long", "append", GroupStateTimeout.NoTimeout
    )


class EventSplitter:
    """Server-sent events from chunks: lines end at LF, CR or CRLF, also where a chunk cuts a CRLF in two."""

    def __init__(self, buffer: str = "", pending_cr: bool = False) -> None:
        self.buffer, self.pending_cr = buffer, pending_cr

    def feed(self, chunk: str) -> list[tuple[str, str]]:
        if self.pending_cr and chunk.startswith("\n"):
            chunk = chunk[1:]
        if chunk:
            self.pending_cr = chunk.endswith("\r")
        self.buffer += chunk.replace("\r\n", "\n").replace("\r", "\n")
        if len(self.buffer) > EVENT_LIMIT:
            raise ValueError("event too large")
        *frames, self.buffer = self.buffer.split("\n\n")
        return [found for f in frames if (found := self.parse(f))]

    @staticmethod
    def parse(frame: str) -> tuple[str, str] | None:
        event, data = "message", []
        for line in frame.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
        return (event, "\n".join(data)) if data else None


def split_events(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data) of a stream of chunks (stream_id, seq, chunk)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        splitter = EventSplitter(*(state.get if state.exists else ("", False)))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], seq, event, data) for seq, chunk in zip(rows["seq"], rows["chunk"]) for event, data in splitter.feed(chunk)]
        state.update((splitter.buffer, splitter.pending_cr))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "event", "data"])

    return chunks.groupBy("stream_id").applyInPandasWithState(
        step, "stream_id string, seq long, event string, data string", "buffer string, pending boolean", "append", GroupStateTimeout.NoTimeout
    )


def idle_sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): events of a key with less than ``gap`` between them. Works on streams with a watermark."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
