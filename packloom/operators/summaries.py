"""Counts, searches, paging and comparisons over packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_ascii, equals_ascii, host_of, port_of

MOST_ROWS, FIRST_ROWS = 1000, 100


def protocol_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))


def protocol_percent(packets: DataFrame) -> DataFrame:
    counts = protocol_counts(packets)
    total = counts.agg(F.sum("packets").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("protocol", "packets", (F.col("packets") * 100.0 / F.col("total")).alias("percent"))


def endpoint_counts(packets: DataFrame) -> DataFrame:
    """Packets per endpoint; a packet counts for its source and for its destination."""
    ends = packets.select(F.explode(F.array("source", "destination")).alias("endpoint")).filter("endpoint <> ''")
    return ends.groupBy("endpoint").agg(F.count(F.lit(1)).alias("packets"))


def top_endpoints(packets: DataFrame, k: int = 10) -> DataFrame:
    return endpoint_counts(packets).orderBy(F.desc("packets"), "endpoint").limit(k)


def host_counts(packets: DataFrame) -> DataFrame:
    return endpoint_counts(packets).groupBy(host_of(F.col("endpoint")).alias("host")).agg(F.sum("packets").alias("packets"))


def port_counts(packets: DataFrame) -> DataFrame:
    """Packets per port; source and destination count apart."""
    counts = endpoint_counts(packets).groupBy(port_of(F.col("endpoint")).alias("port")).agg(F.sum("packets").alias("packets"))
    return counts.filter("port is not null")


def capture_stats(packets: DataFrame) -> DataFrame:
    """Packets, streams and the time that they span, from the least to the largest timestamp."""
    return packets.agg(
        F.count(F.lit(1)).alias("packet_count"), F.count_distinct("capture", "stream_key").alias("stream_count"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1e9).alias("duration_s"),
    )


def capture_summary(packets: DataFrame) -> DataFrame:
    """As capture_stats, but with the timestamps of the first and last packet that have one."""
    first = F.expr("min_by(ts_ns, packet_index) filter (where ts_ns is not null)")
    last = F.expr("max_by(ts_ns, packet_index) filter (where ts_ns is not null)")
    return packets.agg(F.count(F.lit(1)).alias("packet_count"), F.count_distinct("capture", "stream_key").alias("stream_count"), first.alias("first_ns"), last.alias("last_ns"), F.greatest(F.lit(0), F.call_function("div", last - first, F.lit(1_000_000))).cast("long").alias("duration_ms"))


def decode_issues(packets: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per issue: capture, packet_index, kind, offset, and its place in the packet."""
    out = packets.select("capture", "packet_index", F.posexplode("issues").alias("place", "issue")).select("capture", "packet_index", F.col("place").cast("int").alias("place"), F.col("issue.kind").alias("kind"), F.col("issue.offset").alias("offset"))
    return out if kind is None else out.filter(equals_ascii(F.col("kind"), kind))


def issue_total(packets: DataFrame) -> DataFrame:
    return packets.agg(F.coalesce(F.sum(F.size("issues").cast("long")), F.lit(0).cast("long")).alias("issues"), F.count_if(F.size("issues") > 0).alias("packets_with_issues"))


def description(packets: DataFrame) -> DataFrame:
    """(what, name, n): packets, issues, each protocol and the ten busiest endpoints."""
    row = lambda df, what, name, n: df.select(F.lit(what).alias("what"), name.alias("name"), n.cast("long").alias("n"))
    totals = issue_total(packets).crossJoin(F.broadcast(packets.agg(F.count(F.lit(1)).alias("packets"))))  # a row each
    out = row(totals, "packets", F.lit(""), F.col("packets")).unionByName(row(totals, "issues", F.lit(""), F.col("issues")))
    return out.unionByName(row(protocol_counts(packets), "protocol", F.col("protocol"), F.col("packets"))).unionByName(row(top_endpoints(packets), "endpoint", F.col("endpoint"), F.col("packets")))


def describe_capture(packets: DataFrame) -> dict:
    """description() as one object, protocols and endpoints in order of their packets."""
    rows = sorted(description(packets).collect(), key=lambda r: (-r.n, r.name))
    of = lambda what: [(r.name, r.n) for r in rows if r.what == what]
    return {"packet_count": of("packets")[0][1], "decode_issue_count": of("issues")[0][1], "protocols": of("protocol"), "top_endpoints": of("endpoint")}


#: Columns of packets that search() reads, beside those of its filter.
SEARCHED = ["protocol", "source", "destination", "src_port", "dst_port", "issues", "layer_names"]


def page(df: DataFrame, order: list, offset: int = 0, limit: int = FIRST_ROWS) -> DataFrame:
    """Rows offset .. offset + limit of an order; no more than MOST_ROWS at a time."""
    return df.orderBy(*order).offset(offset).limit(min(limit, MOST_ROWS))


def search(
    packets: DataFrame, protocol: str | None = None, source: str | None = None, destination: str | None = None, port: int | None = None,
    has_issues: bool | None = None, text: str | None = None, matching: Column | None = None, exact: bool = False,
) -> DataFrame:
    """Packets that meet all given conditions. protocol, source and destination are parts of
    the packet's texts, or (exact=True) the whole; A-Z and a-z are alike. text is a part of
    any of them or of a layer's name. `matching` is a compiled display filter."""
    test = equals_ascii if exact else contains_ascii
    for name, value in (("protocol", protocol), ("source", source), ("destination", destination)):
        if value is not None:
            packets = packets.filter(test(F.col(name), value))
    if port is not None:
        packets = packets.filter((F.col("src_port") == port) | (F.col("dst_port") == port))
    if has_issues is not None:
        packets = packets.filter((F.size("issues") > 0) == has_issues)
    if text is not None:
        anywhere = [contains_ascii(F.col(c), text) for c in ("protocol", "source", "destination")]
        packets = packets.filter(anywhere[0] | anywhere[1] | anywhere[2] | F.exists("layer_names", lambda x: contains_ascii(x, text)))
    return packets if matching is None else packets.filter(matching)


#: What captures are compared by, and the columns of packets that compare() and compare_deltas() read.
KINDS = ("host", "protocol", "port")
COMPARED = ["capture", "protocol", "source", "destination", "stream_key"]


def compare(a: DataFrame, b: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Hosts, protocols and ports that one of two captures alone has: kind, side (only_a or
    only_b), key, packets. One aggregate over the keys of both."""

    def keys(p: DataFrame, in_a: int) -> DataFrame:
        ends = [F.col("source"), F.col("destination")]
        of = {"protocol": [F.col("protocol")], "host": [F.when(e != "", host_of(e)) for e in ends], "port": [port_of(e).cast("string") for e in ends]}
        each = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k in kinds for c in of[k]])
        return p.select(F.explode(each).alias("k"), F.lit(in_a).alias("in_a")).select("k.*", "in_a").filter("key is not null")

    counts = keys(a, 1).unionByName(keys(b, 0)).groupBy("kind", "key").agg(F.sum("in_a").alias("in_a"), F.count(F.lit(1)).alias("packets"))
    alone = counts.filter("in_a = 0 or in_a = packets")
    return alone.select("kind", F.when(F.col("in_a") > 0, "only_a").otherwise("only_b").alias("side"), "key", "packets")


def compare_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Packets and streams of b less those of a."""
    one = lambda p, s: p.agg(F.count(F.lit(1)).alias(f"packets_{s}"), F.count_distinct("capture", "stream_key").alias(f"streams_{s}"))
    return one(a, "a").crossJoin(F.broadcast(one(b, "b"))).select("packets_a", "packets_b", (F.col("packets_b") - F.col("packets_a")).alias("packet_delta"), "streams_a", "streams_b", (F.col("streams_b") - F.col("streams_a")).alias("stream_delta"))


def check_limit(frames: DataFrame, most: int | None = 100_000) -> DataFrame:
    """`frames`, or an error if there are more than `most` (undecodable ones count too)."""
    if most is not None and frames.limit(most + 1).count() > most:
        raise ValueError(f"the capture has more than {most} packets")
    return frames
