"""Conversations: dense indexes, canonical keys, stream ids and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Stored

#: Rows of an order that one task numbers; only counts of such stretches are summed up.
STRETCH = 1 << 20


def dense_index(df: DataFrame, by: list[str], order: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """`df` with 0, 1, 2 ... in the order of `order` (a long, unique within `by`).

    No window spans a whole capture: rows are numbered within stretches of `order`, and the
    stretches' counts (a row for each) are summed up before."""
    cut = df.withColumn("_stretch", F.expr(f"{order} div {stretch}"))
    counts = cut.groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_stretch").orderBy(order)
    return cut.join(counts, [*by, "_stretch"]).withColumn(name, F.row_number().over(inside) - 1 + F.col("_before")).drop("_stretch", "_before")


def with_packet_index(frames: DataFrame) -> DataFrame:
    """The frames that decode (all with an Ethernet header), numbered from 0 in each capture;
    frame_no counts all frames. Sources number them as they read (packet_index is null for
    others); only frames without that column are counted here."""
    if "packet_index" in frames.columns:
        return frames.filter("packet_index is not null")
    return dense_index(frames.filter("cap_len >= 14"), ["capture"], "frame_no", "packet_index")


#: Columns of packets that streams() reads.
STREAM_COLUMNS = ["capture", "packet_index", "ts_ns", "cap_len", "stream_key", "tcp"]


def narrow(packets: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of packets as a stored table, for what reads them more than once: frames are
    decoded once, and their bytes go no further."""
    return Stored(packets.sparkSession, "packets").put(packets.select(*dict.fromkeys(columns)))


def streams(packets: DataFrame) -> DataFrame:
    """One row per conversation, with stream_id in the order of first packets of its capture.

    first_seen is the first timestamp that there is, last_seen that of the last packet, even
    if it has none; there is no timeout. rst_count stops at 65535."""
    flags = F.coalesce(F.col("tcp.flag_bits"), F.lit(0))
    grouped = packets.filter("stream_key is not null").groupBy("capture", "stream_key").agg(
        F.min("packet_index").alias("first_index"), F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("cap_len").cast("long")).alias("byte_count"),
        F.expr("min_by(ts_ns, packet_index) filter (where ts_ns is not null)").alias("first_seen_ns"), F.max_by("ts_ns", "packet_index").alias("last_seen_ns"),
        F.bit_or(flags).alias("tcp_flags_seen"), F.bool_or(flags.bitwiseAND(18) == 18).alias("syn_ack_seen"), F.least(F.count_if(flags.bitwiseAND(4) == 4), F.lit(65535)).cast("int").alias("rst_count"),
    )
    return dense_index(Stored(packets.sparkSession, "streams").put(grouped), ["capture"], "first_index", "stream_id")


def with_stream_id(packets: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """`packets` with stream_id, null where there is no conversation. Without a table of streams
    the packets are read twice: give narrow() ones."""
    ids = (table if table is not None else streams(packets)).select("capture", "stream_key", "stream_id")
    return packets.join(ids, ["capture", "stream_key"], "left").select(*packets.columns, "stream_id")


def stream_packets(packets: DataFrame, stream_id: int) -> DataFrame:
    """The packets of one conversation (of each capture that has it) in order; an unknown id is an error."""
    table = streams(packets)
    key = table.filter(F.col("stream_id") == stream_id).select("capture", "stream_key", "stream_id")
    if key.isEmpty():
        last = table.agg(F.max("stream_id")).first()[0]
        raise ValueError(f"no stream {stream_id}" + (f"; valid IDs: 0..{last}" if last is not None else "; the capture has none"))
    # A row for each capture.
    return packets.join(F.broadcast(key), ["capture", "stream_key"]).select(*packets.columns, "stream_id").orderBy("capture", "packet_index")


def key_end(which: str, key: str = "stream_key") -> tuple[Column, Column]:
    """Address (4 or 16 bytes) and port of a key's "lo" or "hi" end."""
    at = 2 if which == "lo" else 20
    c = F.col(key)
    address = F.when(key_family(key) == 4, F.substring(c, at, 4)).otherwise(F.substring(c, at, 16))
    return address, F.conv(F.hex(F.substring(c, at + 16, 2)), 16, 10).cast("int")


def key_family(key: str = "stream_key") -> Column:
    return F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int")


def key_protocol(key: str = "stream_key") -> Column:
    return F.conv(F.hex(F.substring(key, 38, 1)), 16, 10).cast("int")


def describe_streams(table: DataFrame) -> DataFrame:
    """Streams with texts for their ends (v6 in brackets), protocol and duration."""
    from ..functions.scalars import ip_text

    def end(which: str):
        address, port = key_end(which)
        text = ip_text(key_family(), address)
        shown = F.when(key_family() == 6, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
        return F.concat(shown, F.lit(":"), port.cast("string"))

    protocol = F.when(key_protocol() == 6, "TCP").when(key_protocol() == 17, "UDP").otherwise("Unknown")
    return table.select(
        "capture", "stream_id", protocol.alias("protocol"), end("lo").alias("endpoint_a"), end("hi").alias("endpoint_b"), "packet_count", "byte_count",
        "first_seen_ns", "last_seen_ns", F.greatest(F.lit(0), F.expr("(last_seen_ns - first_seen_ns) div 1000000")).alias("duration_ms"), "tcp_flags_seen", "syn_ack_seen", "rst_count",
    )
