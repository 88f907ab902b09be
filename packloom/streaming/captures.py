"""Captures as streams: packets of arriving files, and conversations kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dissect import dissect
from ..sources.pcap import SCHEMA, parse_capture


def stream_packets(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Packets of the capture files that arrive in a folder, a file a row of the source."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def rows(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(parse_capture(content, p, strict=False), columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"packet_index": "Int64", "ts_ns": "Int64"})

    return dissect(files.select("path", "content").mapInPandas(rows, SCHEMA)).filter("decode_error is null")


def running_streams(packets: DataFrame, lateness: str | None = None) -> DataFrame:
    """Conversations so far over a stream of packets, each capture's on their own. Dense ids in the order
    of first packets can't be kept across micro-batches, so the id is a hash of capture and key. First
    and last timestamps are those of the first packet that has one and of the last packet. With a
    lateness, state of windows that are over is dropped; without one it is kept, as conversations
    never time out."""
    bits = F.coalesce(F.col("tcp.flag_bits"), F.lit(0))
    keyed = packets.filter("stream_key is not null").withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    groups = ["capture", "stream_key"]
    if lateness is not None:
        keyed = keyed.withWatermark("ts", lateness).withColumn("window", F.window("ts", "1 hour"))
        groups.append("window")
    return keyed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("cap_len").cast("long")).alias("byte_count"),
        F.expr("min_by(ts_ns, packet_index) filter (where ts_ns is not null)").alias("first_seen_ns"), F.max_by("ts_ns", "packet_index").alias("last_seen_ns"),
        F.bit_or(bits).alias("tcp_flags_seen"), F.bool_or(bits.bitwiseAND(18) == 18).alias("syn_ack_seen"), F.least(F.count_if(bits.bitwiseAND(4) == 4), F.lit(65535)).cast("int").alias("rst_count"),
    ).withColumn("stream_hash", F.xxhash64("capture", "stream_key"))
