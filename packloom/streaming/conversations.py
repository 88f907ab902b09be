"""Conversations over a stream of packets, with state that Spark keeps for each.

What is known of a conversation can be merged in any order: counts and sums add up, and the first and last packets are
those of the least and largest index so far, so a first packet that arrives late still becomes the first.

Without an idle time that is an aggregate, whose state Spark reads and writes a conversation at a time without Python. Ends need timers:
there each Arrow batch is merged by conversation before the shuffle (one that has most packets costs its task a row a
batch), and a processor is called for each conversation that a batch changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: timed_*: the first packet that has a time.
PART = "first_index bigint, timed_index bigint, first_ns bigint, last_index bigint, last_ns bigint, packets bigint, bytes bigint, flags int, syn_ack boolean, rsts bigint"
_FIELDS = [x.split()[0] for x in PART.split(", ")]
RESULT = "capture string, stream_key binary, first_index bigint, packet_count bigint, byte_count bigint, first_seen_ns bigint, last_seen_ns bigint, tcp_flags_seen int, syn_ack_seen boolean, rst_count int, closed boolean"

_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def merged(a: tuple, b: tuple) -> tuple:
    """What two parts of a conversation say together."""
    one, other = (dict(zip(_FIELDS, x, strict=True)) for x in (a, b))
    timed = min((x for x in (one, other) if x["timed_index"] is not None), key=lambda x: x["timed_index"], default=one)
    last = max(one, other, key=lambda x: x["last_index"])
    return (
        min(one["first_index"], other["first_index"]), timed["timed_index"], timed["first_ns"], last["last_index"], last["last_ns"],
        one["packets"] + other["packets"], one["bytes"] + other["bytes"], one["flags"] | other["flags"], one["syn_ack"] or other["syn_ack"], one["rsts"] + other["rsts"],
    )


def _parts(batches):
    """A row for each conversation in a batch of (capture, stream_key, packet_index, ts_ns, cap_len, bits)."""
    import pandas as pd

    for b in batches:
        found: dict[tuple, tuple] = {}
        for capture, key, index, ts, size, bits in zip(*(b[c].tolist() for c in ("capture", "stream_key", "packet_index", "ts_ns", "cap_len", "bits")), strict=True):
            ts = None if pd.isna(ts) else int(ts)
            part = (index, None if ts is None else index, ts, index, ts, 1, size, bits, bits & 18 == 18, int(bits & 4 == 4))
            found[capture, key] = merged(found[capture, key], part) if (capture, key) in found else part
        rows = [(*k, pd.to_datetime(v[4] if v[4] is not None else v[2], unit="ns"), *v) for k, v in found.items()]
        out = pd.DataFrame(rows, columns=["capture", "stream_key", "ts", *_FIELDS])
        yield out.astype({"ts": "datetime64[ns]", **{c: "Int64" for c in ("timed_index", "first_ns", "last_ns")}})


class Conversations(StatefulProcessor):
    """A value for each conversation, and a timer for when it ends."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", PART)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        state = tuple(self.known.get()) if self.known.exists() else None
        if state is not None and self.over(state, timerValues):  # its timer would come after these rows
            yield pd.DataFrame([self.row(key, state, True)], columns=_COLUMNS)
            state = None
        for b in rows:
            for row in b[_FIELDS].astype(object).where(b[_FIELDS].notna(), None).itertuples(index=False):
                part = tuple(x if x is None or isinstance(x, bool) else bool(x) if f == "syn_ack" else int(x) for f, x in zip(_FIELDS, row, strict=True))
                state = part if state is None else merged(state, part)
        self.known.update(state)
        if state[4] is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(state[4] // 1_000_000 + self.idle_ms)
        yield pd.DataFrame([self.row(key, state, False)], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.known.exists():
            state = tuple(self.known.get())
            self.known.clear()
            yield pd.DataFrame([self.row(key, state, True)], columns=_COLUMNS)

    def over(self, state: tuple, times) -> bool:
        return state[4] is not None and state[4] // 1_000_000 + self.idle_ms <= times.getCurrentWatermarkInMs()

    def row(self, key, state: tuple, closed: bool) -> tuple:
        first, _, first_ns, _, last_ns, packets, size, flags, syn_ack, rsts = state
        return (*key, first, packets, size, first_ns, last_ns, flags, syn_ack, min(rsts, 65535), closed)

    def close(self) -> None:
        pass


def running_conversations(packets: DataFrame, idle: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """A row for each conversation that a micro-batch changes, with all that is known of it so far (output mode "update"). Packets
    may arrive in any order and in any division into batches: the last row of a conversation is the same.

    Conversations never end by themselves. With `idle`, one of which no packet came for that long, by the
    packets' times and the watermark (their largest less `lateness`), ends: its row comes again as `closed`, its state goes,
    and what comes later is another one. Packets without a time count, but end nothing."""
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    bits = F.coalesce(F.col("tcp.flag_bits"), F.lit(0))
    read = packets.filter("stream_key is not null").select("capture", "stream_key", "packet_index", "ts_ns", "cap_len", bits.alias("bits"))
    if idle is None:
        return read.groupBy("capture", "stream_key").agg(
            F.min("packet_index").alias("first_index"), F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("cap_len").cast("long")).alias("byte_count"),
            F.min_by("ts_ns", F.when(F.col("ts_ns").isNotNull(), F.col("packet_index"))).alias("first_seen_ns"), F.max_by("ts_ns", "packet_index").alias("last_seen_ns"),
            F.bit_or("bits").alias("tcp_flags_seen"), F.bool_or(F.col("bits").bitwiseAND(18) == 18).alias("syn_ack_seen"), F.least(F.count_if(F.col("bits").bitwiseAND(4) == 4), F.lit(65535)).cast("int").alias("rst_count"),
        ).withColumn("closed", F.lit(False))
    idle_ms = int(spark.range(1).select((F.expr(f"unix_millis(timestamp_seconds(0) + interval {idle})"))).first()[0])
    parts = read.mapInPandas(_parts, f"capture string, stream_key binary, ts timestamp, {PART}").withWatermark("ts", lateness)
    return parts.groupBy("capture", "stream_key").transformWithStateInPandas(Conversations(idle_ms), RESULT, "Update", "EventTime")
