"""HTTP messages over reassembled TCP conversations.

Each direction of a conversation is cut into stretches of bytes, so that no task has a whole conversation. Where a message
ends depends on what came before (the length in its head, the chunks of its body), so a stretch needs a state to start
from. At first each one guesses: it looks for the first start of a message and is parsed from there. Then the
states are carried from stretch to stretch, on rows that have only the bytes up to that start: if the carried state is the
guessing one's there, all that the guess found holds. Bodies pass over bytes that aren't at hand. A stretch that this
leaves open is parsed from its true state, and so are the next ones, up to twice as many each time until all are
known.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wire
from ..storage import Stored, grown

#: The largest bigint, which stands for lengths beyond it.
_MOST = (1 << 63) - 1
#: Bytes of a direction in one stretch; bytes of a head, and of a line between chunks, at most.
STRETCH, MOST_HEAD, MOST_LINE = 1 << 20, 1 << 16, 4096
_START = re.compile(rb"HTTP/1\.[01] [0-9]{3}|(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|TRACE|CONNECT) [!-~]+ HTTP/1\.[01]\r\n")
#: More bytes than these can't be the first ones of a start; a stretch's first bytes that are carried, no fewer than those.
_LONGEST, _FIRST = 4096, 1 << 14
_CHUNKED = re.compile(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b")
WAY = ["capture", "stream_key", "direction"]
MESSAGE = "seq bigint, is_request boolean, method string, uri string, status_code int, host string, content_type string, chunked boolean, head_len int, body_len bigint, complete boolean"
_FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]


class Parser:
    """Reads segments in order. Its state is a small dict: a mode, the sequence number that comes next, bytes held back (as
    latin-1 text), where a body or chunk ends, and the message so far."""

    def __init__(self, state: dict | None = None):
        state = state or {"mode": "head"}
        self.mode, self.next, self.until, self.message = state["mode"], state.get("next"), state.get("until"), state.get("message")
        self.held = state.get("held", "").encode("latin-1")
        self.found = False

    def state(self) -> dict:
        return {"mode": self.mode, "next": self.next, "until": self.until, "held": self.held.decode("latin-1"), "message": self.message and {**self.message}}

    def finish(self, complete: bool = True) -> Iterator[dict]:
        if self.message is not None:
            yield {**self.message, "complete": complete}
        self.mode, self.message, self.until = "head", None, None

    def end(self) -> Iterator[dict]:
        """The message that the conversation's end cuts off; a body without a length ends there."""
        yield from self.finish(self.mode == "rest")

    def lost(self, seq: int) -> bool:
        return self.next is not None and seq != self.next

    def feed(self, seq: int, data: bytes) -> Iterator[dict]:
        if self.lost(seq):
            yield from self.finish(False)
            self.mode, self.held = "search", b""
        buf, base, at = self.held + data, seq - len(self.held), 0
        self.next, self.held = seq + len(data), b""
        while at < len(buf):
            step = getattr(self, self.mode)(buf, base, at)
            if step is None:
                self.held = buf[at:]
                return
            at, done = step
            if done:
                yield from self.finish()

    def passes(self, seq: int, size: int, blank: bool) -> bool:
        """Whether the state after these bytes follows without them; blank: no message starts in them."""
        mode = "search" if self.lost(seq) else self.mode
        return mode == "rest" or (mode in ("body", "chunk") and self.until >= seq + size) or (mode == "search" and blank)

    def skip(self, seq: int, size: int) -> Iterator[dict]:
        """Goes over bytes that it passes()."""
        yield from self.feed(seq, b"")
        self.next, self.held = seq + size, b""
        if self.mode == "rest":
            self.message["body_len"] += size
        elif self.mode == "chunk" and self.until == self.next:
            self.mode = "line"
        elif self.mode == "body" and self.until == self.next:
            yield from self.finish()

    def search(self, buf: bytes, base: int, at: int):
        m = _START.search(buf, at)
        if m is None:  # no start goes on over a newline, so what is held depends on the last bytes alone
            self.held = buf[max(at, buf.rfind(b"\n", at) + 1, len(buf) - _LONGEST) :]
            return len(buf), False
        self.mode, self.found = "head", True
        return m.start(), False

    def head(self, buf: bytes, base: int, at: int):
        if buf.startswith(b"\r\n", at):
            return at + 2, False
        if not _START.match(buf, at):
            if len(buf) - at < 16 or (b"\r\n" not in buf[at : at + _LONGEST] and len(buf) - at < _LONGEST):
                return None
            self.mode = "search"
            return at + 1, False
        end = buf.find(b"\r\n\r\n", at)
        if end < 0:
            if len(buf) - at <= MOST_HEAD:
                return None
            self.mode = "search"
            return at + 1, False
        head = buf[at : end + 2]
        said = wire.http_head(head)
        size, chunked = said["content_length"], bool(_CHUNKED.search(head))
        self.message = {k: said[k] for k in ("is_request", "method", "uri", "status_code", "host", "content_type")} | {"seq": base + at, "chunked": chunked, "head_len": end + 4 - at, "body_len": 0}
        status = said["status_code"] or 0
        if chunked:
            self.mode = "line"
        elif size is not None and not (100 <= status < 200 or status in (204, 304)):
            self.message["body_len"] = min(int(size), _MOST)
            self.mode, self.until = "body", base + end + 4 + int(size)
            return end + 4, size == 0
        elif said["is_request"] or 100 <= status < 200 or status in (204, 304):
            return end + 4, True
        else:
            self.mode = "rest"
        return end + 4, False

    def body(self, buf: bytes, base: int, at: int):
        past = min(len(buf), self.until - base)
        return past, base + past == self.until

    def line(self, buf: bytes, base: int, at: int):
        end = buf.find(b"\r\n", at)
        if end < 0 and len(buf) - at <= MOST_LINE:
            return None
        digits = buf[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", digits):
            self.mode, self.message = "search", None
            return at + 1, False
        size = int(digits, 16)
        self.message["body_len"] += size
        self.mode, self.until = ("chunk", base + end + 2 + size + 2) if size else ("trailer", None)
        return end + 2, False

    def chunk(self, buf: bytes, base: int, at: int):
        past = min(len(buf), self.until - base)
        if base + past == self.until:
            self.mode = "line"
        return past, False

    def trailer(self, buf: bytes, base: int, at: int):
        end = buf.find(b"\r\n", at)
        if end < 0:
            return None if len(buf) - at <= MOST_HEAD else (len(buf), True)
        return end + 2, end == at

    def rest(self, buf: bytes, base: int, at: int):
        self.message["body_len"] += len(buf) - at
        return len(buf), False


_ROW = "capture string, stream_key binary, direction string, stretch bigint"
_LOOKED = f"{_ROW}, pieces array<struct<seq: bigint, data: binary>>, near array<struct<seq: bigint, size: bigint, data: binary>>, found bigint, there string, past string, messages array<struct<{MESSAGE}>>"
_CARRIED = f"{_ROW}, entry string, holds boolean, messages array<struct<{MESSAGE}>>"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def _near(pieces: list[dict], found: int | None) -> list[dict]:
    """A stretch's pieces, of which those before the found one have their data at the begin and where a search for it needs
    them; what follows each other without data is one."""
    last = len(pieces) if found is None else found
    sizes, out = [len(p["data"]) for p in pieces], []
    before, behind = 0, sum(sizes[:last])
    for i, (p, n) in enumerate(zip(pieces, sizes, strict=True)):
        behind -= n
        if i == last or (i < last and (before < _FIRST or behind < _LONGEST)):
            out.append({"seq": p["seq"], "size": n, "data": p["data"]})
        elif out and out[-1]["data"] is None and out[-1]["seq"] + out[-1]["size"] == p["seq"]:
            out[-1]["size"] += n
        else:
            out.append({"seq": p["seq"], "size": n, "data": None})
        before += n
    return out


def _look(schema: pa.Schema):
    """What a stretch has if its first message is the first that a search finds: the piece in which that one's start ends, the
    parser's states there and at the stretch's end, and the messages that end between."""

    def run(batches):
        for b in batches:
            new = []
            for pieces in b.column("pieces").to_pylist():
                parser, found, there, messages = Parser({"mode": "search"}), None, None, []
                for i, piece in enumerate(pieces):
                    got = list(parser.feed(piece["seq"], piece["data"]))
                    if found is not None:
                        messages += got
                    elif parser.found:
                        found, there = i, json.dumps(parser.state())
                new.append((_near(pieces, found), None if found is None else pieces[found]["seq"], there, None if found is None else json.dumps(parser.state()), messages))
            more = [pa.array([r[k] for r in new], f.type) for k, f in enumerate(list(schema)[5:])]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in list(schema)[:5]), *more], schema=schema)

    return run


def _carry(schema: pa.Schema):
    """Rows of whole directions in order. Out come the messages that end before a guess holds, and what becomes of each stretch:
    whether its guess holds, or, with the state that it starts from, that its bytes are needed; then what follows isn't looked at."""

    def run(batches):
        way, last, parser, out = None, None, None, []

        def end():
            if parser is not None and (cut := list(parser.end())):
                out.append((*way, last, None, True, cut))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            for row in b.to_pylist():
                if way != (this := (row["capture"], row["stream_key"], row["direction"])):
                    end()
                    way, parser = this, Parser(json.loads(row["entry"]) if row["entry"] else None)
                if parser is None:
                    continue
                last, entry, messages, holds, found = row["stretch"], parser.state(), [], False, row["found"]
                for p in row["near"]:
                    if p["data"] is not None:
                        messages += parser.feed(p["seq"], p["data"])
                        if p["seq"] == found and parser.state() == json.loads(row["there"]):
                            holds, parser = True, Parser(json.loads(row["past"]))
                            break
                    elif parser.passes(p["seq"], p["size"], found is None or p["seq"] < found):
                        messages += parser.skip(p["seq"], p["size"])
                    else:
                        out.append((*way, last, json.dumps(entry), False, []))
                        parser = None
                        break
                if parser is not None and (messages or not holds):
                    out.append((*way, last, None, holds, messages))
            yield batch()
            out.clear()
        end()
        yield batch()

    return run


def http_messages(segments: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """HTTP/1 messages of segments as reassemble() gives them: capture, stream_key, direction, and the fields of MESSAGE. seq is where
    a message starts; head_len counts its head with the blank line, body_len its body without what chunks add.

    A message is complete if all its bytes are there; a body without a length goes to the conversation's end. After lost bytes
    the next start is searched for. What is no HTTP is passed over. Without segments there are no messages."""
    kept = Stored(segments.sparkSession, "http-messages")
    cut = segments.withColumn("stretch", F.expr(f"seq div {stretch}L")).groupBy(*WAY, "stretch").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("pieces"))
    looked = kept.put(cut.mapInArrow(_look(_arrow(_LOOKED)), _LOOKED))
    given = [*WAY, "stretch", "entry", "near", "found", "there", "past"]
    rows, known, run = looked.withColumn("entry", F.lit(None).cast("string")).select(given), [], 1
    while True:
        known.append(kept.put(rows.repartition(*WAY).sortWithinPartitions(*WAY, "stretch").mapInArrow(_carry(_arrow(_CARRIED)), _CARRIED)))
        left = known[-1].filter("entry is not null").select(*WAY, F.col("stretch").alias("since"), "entry")
        if left.isEmpty():
            break
        whole = F.expr("transform(pieces, p -> struct(p.seq as seq, cast(octet_length(p.data) as bigint) as size, p.data as data))")
        rows = looked.join(grown(left), WAY).filter("stretch >= since").withColumn("near", F.when(F.col("stretch") < F.col("since") + run, whole).otherwise(F.col("near"))).select(given)
        run *= 2
    states = known[0]
    for more in known[1:]:
        states = states.unionByName(more)
    states = states.filter("entry is null")
    held = looked.filter("size(messages) > 0").select(*WAY, "stretch", "messages").join(grown(states.filter("not holds").select(*WAY, "stretch")), [*WAY, "stretch"], "left_anti")
    return held.unionByName(states.select(*held.columns)).select(*WAY, F.explode("messages").alias("m")).select(*WAY, "m.*")
