"""Redaction of event streams with keyed state.

A value may arrive in pieces, so text is held back: what is emitted ends at a blank that lies more
than 64 bytes before the end of what has arrived. State is one stream's held text, its numbering,
counts and the shape of its last text event.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import canonical
from ..functions.kernel import Kernel, Scope
from ..functions.patterns import Detector, detectors
from ..functions.wire import family
from ..functions.wire import gemini_column
from ..shipping import ship

#: Bytes held back, and the blanks at which held text may be cut.
TAIL, BLANKS = 64, b" \t\r\n"
#: Event types that end a block of text.
BLOCK_ENDS = ("content_block_stop", "message_stop")


def stream_format(path: str) -> str:
    if "/chat/completions" in path:
        return "chat"
    return "messages" if "/messages" in path else "gemini" if family(path) == "gemini" else "other"


def stream_format_column(path: Column) -> Column:
    return F.when(path.contains("/chat/completions"), "chat").when(path.contains("/messages"), "messages").when(gemini_column(path), "gemini").otherwise("other")


def _dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def _dicts(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


@dataclass
class Stream:
    """One stream's redactor. Plain data, so that it can be kept as state."""

    path: str
    carry: str = ""
    last: dict | None = None  # the last text event's place: {"index": ...} or {}
    numbers: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    keep_all: bool = False  # hold text until its block ends
    assign: Callable[[str, str], str] | None = None  # numbering in place of the stream's own; not kept as state
    told: dict = field(default_factory=dict)  # counts that output rows carry already

    def text(self, text: str, kernel: Kernel, reveal: Callable[[str], str] | None) -> str:
        out = kernel.redact(text, Scope(self.numbers, self.counts, self.assign))
        return reveal(out) if reveal else out

    def feed(self, text: str, kernel, reveal) -> str:
        self.carry += text
        if self.keep_all or self.carry.count("-----BEGIN") > self.carry.count("-----END"):
            return ""
        data = self.carry.encode("utf-8", "surrogatepass")
        head = data[: max(0, len(data) - TAIL)]
        cut = max(head.rfind(b) for b in (BLANKS[i : i + 1] for i in range(len(BLANKS)))) + 1
        if not cut:
            return ""
        self.carry = data[cut:].decode("utf-8", "surrogatepass")
        return self.text(data[:cut].decode("utf-8", "surrogatepass"), kernel, reveal)

    def flush(self, kernel, reveal) -> list[str]:
        """Held text as an event of its own, in the shape of the last text event."""
        if not self.carry or self.last is None:
            return []
        text, self.carry = self.text(self.carry, kernel, reveal), ""
        if stream_format(self.path) == "messages":
            event = {"type": "content_block_delta", "index": self.last.get("index"), "delta": {"type": "text_delta", "text": text}}
            return ["event: content_block_delta\n", f"data: {canonical.dumps(event)}\n\n"]
        return [f"data: {canonical.dumps({'choices': [{'index': 0, 'delta': {'content': text}}]})}\n\n"]

    def line(self, line: str, kernel: Kernel, reveal=None) -> list[tuple[str, bool]]:
        """Output lines of one input line, each with whether it was made here."""
        payload = line.rstrip("\r\n")[5:].strip() if line.startswith("data:") else ""
        if not payload:
            return [(line, False)]
        if payload == "[DONE]":
            return [*((x, True) for x in self.flush(kernel, reveal)), (line, False)]
        try:
            event = canonical.loads(payload)
        except (ValueError, RecursionError):
            return [(line, False)]
        if not isinstance(event, dict):
            return [(line, False)]
        out = [(x, True) for x in self.flush(kernel, reveal)] if self._ends(event) else []
        changed = self._event(event, kernel, reveal)
        return [*out, (f"data: {canonical.dumps(event)}\n" if changed else line, False)]

    def _ends(self, event: dict) -> bool:
        kind = stream_format(self.path)
        if kind == "messages":
            return event.get("type") in BLOCK_ENDS
        return kind == "chat" and any(isinstance(c.get("finish_reason"), str) and c["finish_reason"] for c in _dicts(event.get("choices")))

    def _event(self, event: dict, kernel, reveal) -> bool:
        kind, changed = stream_format(self.path), False

        def replace(node: dict, key: str, held: dict | None = None) -> None:
            nonlocal changed
            if isinstance(node.get(key), str):
                if held is not None:
                    self.last = held
                node[key] = (self.feed if held is not None else self.text)(node[key], kernel, reveal)
                changed = True

        if kind == "messages":
            if event.get("type") == "content_block_delta":
                delta = _dict(event.get("delta"))
                replace(delta, "text", {"index": event.get("index")})
                if not changed:
                    replace(delta, "partial_json")
        elif kind == "chat":
            for choice in _dicts(event.get("choices")):
                replace(_dict(choice.get("delta")), "content", {})
        elif kind == "gemini":
            for candidate in _dicts(event.get("candidates")):
                for part in _dicts(_dict(candidate.get("content")).get("parts")):
                    replace(part, "text")
        else:
            replace(event, "delta")
            replace(event, "text")
            for key in ("text", "partial_json"):
                replace(_dict(event.get("delta")), key)
        return changed


def _told(s: Stream, make: Callable[[], list]) -> list[tuple[str, bool, dict[str, int]]]:
    """Lines that ``make`` gives, the last one with the counts that ``s`` gained meanwhile; gains without
    a line wait for the next one."""
    lines = make()
    if not lines:
        return []
    gained = {k: n - s.told.get(k, 0) for k, n in s.counts.items() if n > s.told.get(k, 0)}
    s.told = dict(s.counts)
    return [*((x, made, {}) for x, made in lines[:-1]), (*lines[-1], gained)]


def process(path: str, lines: Iterable[str], kernel: Kernel, reveal=None, keep_all: bool = False, assign: Callable[[str, str], str] | None = None) -> tuple[list[tuple[str, bool]], dict[str, int]]:
    """A whole stream at once: output lines and counts."""
    s = Stream(path, keep_all=keep_all, assign=assign)
    out = [x for line in lines for x in s.line(line, kernel, reveal)]
    return out + [(x, True) for x in s.flush(kernel, reveal)], s.counts


OUTPUT = "stream_id string, event_seq long, part int, line string, synthetic boolean, counts map<string,int>"
COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]
STATE = "state string"
LAST_PART = 1 << 20


def redact_streams(lines: DataFrame, pack: list[Detector] | None = None, end_timeout_ms: int = 60_000, keep_all: bool = False) -> DataFrame:
    """Streaming ``lines`` (stream_id, path, event_seq, line) -> (stream_id, event_seq, part, line,
    synthetic, counts); a row's counts are what was replaced since the row before.

    State by stream. Lines are handled in event_seq order, which counts from 0 without gaps in each
    stream: one that arrives early waits in the state. A stream without lines for ``end_timeout_ms``
    has ended, and what it holds is emitted; so is what waits behind a gap, in order.
    """
    ship(lines.sparkSession)
    kernel = Kernel(pack if pack is not None else detectors())

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"next": 0, "early": {}, "stream": None}
        rows = []

        def take(seq: int, path: str, line: str) -> None:
            if saved["stream"] is None:
                saved["stream"] = vars(Stream(path, keep_all=keep_all))
            s = Stream(**saved["stream"])
            rows.extend((key[0], seq, i, *x) for i, x in enumerate(_told(s, lambda: s.line(line, kernel))))
            saved["stream"], saved["next"] = vars(s), seq + 1

        if state.hasTimedOut:
            for seq in sorted(saved["early"], key=int):
                take(int(seq), *saved["early"][seq])
            if saved["stream"]:
                s = Stream(**saved["stream"])
                rows.extend((key[0], saved["next"] - 1, LAST_PART + i, *x) for i, x in enumerate(_told(s, lambda: [(x, True) for x in s.flush(kernel, None)])))
            state.remove()
        else:
            for pdf in frames:
                for seq, path, line in zip(pdf["event_seq"].tolist(), pdf["path"], pdf["line"]):
                    if seq >= saved["next"]:  # a repeated line is dropped
                        saved["early"][str(seq)] = (path, line)
            while str(saved["next"]) in saved["early"]:
                seq = saved["next"]
                take(seq, *saved["early"].pop(str(seq)))
            state.update((json.dumps(saved),))
            state.setTimeoutDuration(end_timeout_ms)
        yield pd.DataFrame(rows, columns=COLUMNS)

    return lines.groupBy("stream_id").applyInPandasWithState(handle, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def redact_stream_table(lines: DataFrame, pack: list[Detector] | None = None, keep_all: bool = False, reveal: Callable[[str], str] | None = None) -> DataFrame:
    """The same for streams that lie in a table, in event_seq order. Lines are sorted by Spark, which
    spills, and pass one by one: a task holds one stream's state, never a stream. ``reveal`` maps
    redacted text to what the client sees."""
    ship(lines.sparkSession)
    kernel = Kernel(pack if pack is not None else detectors())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sid = seq = None
        rows: list[tuple] = []

        def end() -> None:
            if s is not None:
                rows.extend((sid, seq, LAST_PART + i, *x) for i, x in enumerate(_told(s, lambda: [(x, True) for x in s.flush(kernel, reveal)])))

        for pdf in batches:
            for now, path, n, line in zip(pdf["stream_id"], pdf["path"], pdf["event_seq"].tolist(), pdf["line"]):
                if s is None or now != sid:
                    end()
                    s, sid = Stream(path, keep_all=keep_all), now
                seq = n
                rows.extend((sid, seq, i, *x) for i, x in enumerate(_told(s, lambda: s.line(line, kernel, reveal))))
            yield pd.DataFrame(rows, columns=COLUMNS)
            rows.clear()
        end()
        yield pd.DataFrame(rows, columns=COLUMNS)

    dealt = lines.select("stream_id", "path", "event_seq", "line").repartition("stream_id").sortWithinPartitions("stream_id", "event_seq")
    return dealt.mapInPandas(run, OUTPUT)


def counts(redacted: DataFrame) -> DataFrame:
    """The redactor's own counts by stream and kind."""
    return redacted.select("stream_id", F.explode("counts").alias("kind", "n")).groupBy("stream_id", "kind").agg(F.sum("n").cast("long").alias("n"))
