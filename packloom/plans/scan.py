"""Packets of capture files by a display filter, whose plain conditions are decided in the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dissect import PACKET, dissect
from ..sources.pcap import SCHEMA, SPLIT_BYTES, scan_capture
from .display_filter import display_filter, filter_columns, necessary


def scan_filter(text: str) -> tuple[Column, list[str]]:
    """What every packet that the filter finds fulfils, as a condition on header columns that a scan can decide, and
    these columns. It leaves out what takes a whole packet or an `or` of different columns."""
    tests = necessary(text)
    condition = F.lit(True)
    for t in tests:
        condition = condition & F.expr(t.sql)
    return condition, sorted({t.column for t in tests})


def read_packets(spark: SparkSession, path: str, text: str, columns: Iterable[str] | None = None, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The packets that the display filter finds (one that doesn't name streams), with `columns` or all. Only frames that may
    pass leave the scan; those are dissected and held against the whole filter."""
    condition, header = scan_filter(text)
    frames = scan_capture(spark, path, mode, split_bytes, header).filter(condition & F.col("error").isNull() & F.col("packet_index").isNotNull())
    given = [c.split()[0] for c in SCHEMA.split(", ")]
    wanted = [c for c in given if c != "data"] + list(PACKET) if columns is None else list(columns)
    packets = dissect(frames.select(*given), {*wanted, *filter_columns(text)})
    return packets.filter(display_filter(text)).select(*wanted)
