"""Tables exported by an external dissector (tab-separated), and texts of followed streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ip_text, with_port
from ..operators.streams import key_end, key_family

# The exported columns in order.
COLUMNS = ["frame.number", "frame.time_epoch", "frame.len", "frame.cap_len", "_ws.col.Protocol", "_ws.col.Info", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst", "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport"]
CERTIFICATE_COLUMNS = ["frame.number", "x509sat.printableString", "x509ce.dNSName"]


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines of a tab-separated export without its header and blank lines; short ones fail."""
    lines = spark.read.text(path).filter(F.trim("value") != "").filter(~F.col("value").startswith(columns[0]))
    parts = F.split("value", "\t", -1)
    fit = F.when(F.size(parts) >= len(columns), parts).otherwise(F.raise_error(F.concat(F.lit("line with too few columns: "), F.col("value"))).cast("array<string>"))
    return lines.select(fit.alias("c")).select(*[F.get("c", F.lit(i)).alias(str(i)) for i in range(len(columns))])


def read_packet_table(spark: SparkSession, path: str) -> DataFrame:
    """Packets of an export: packet_index, ts_ns, cap_len, orig_len, protocol, info, source, destination.
    IPv4 addresses come before IPv6 ones and TCP ports before UDP ones; a timestamp that
    is no number, or negative, is null."""
    t = _tsv(spark, path, COLUMNS)
    some = lambda *c: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in c])
    seconds = F.expr("try_cast(`1` as double)")
    shown = lambda a, b, p, q: with_port(F.coalesce(some(a, b), F.lit("")), some(p, q).cast("int"), bare_brackets=False)
    return t.select(
        F.greatest(F.expr("try_cast(`0` as bigint)") - 1, F.lit(0)).alias("packet_index"), F.when((seconds >= 0) & ~F.isnan(seconds), F.expr("cast(cast(`1` as decimal(30,9)) * 1000000000 as bigint)")).alias("ts_ns"),
        F.expr("try_cast(`3` as int)").alias("cap_len"), F.expr("try_cast(`2` as bigint)").alias("orig_len"), F.col("4").alias("protocol"), F.col("5").alias("info"),
        shown("6", "8", "10", "12").alias("source"), shown("7", "9", "11", "13").alias("destination"),
    )


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """packet_index, common_name and alternative names of an export of certificates."""
    t = _tsv(spark, path, CERTIFICATE_COLUMNS)
    names = F.filter(F.transform(F.split("2", ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.select(F.greatest(F.expr("try_cast(`0` as bigint)") - 1, F.lit(0)).alias("packet_index"), F.when(F.col("1") != "", F.col("1")).alias("common_name"), names.alias("alternative_names"), F.lit(None).cast("string").alias("organization")).filter("common_name is not null or size(alternative_names) > 0")


@dataclass
class Followed:
    """A followed stream: its ends, and (direction, bytes) of its segments in order."""

    client: str
    server: str
    segments: list[tuple[str, bytes]]


# How lines of a followed stream's head begin.
_NODES, _HEAD, _RULE = ("Node 0: ", "Node 1: "), ("Follow:", "Filter:"), "==="


def parse_followed(text: str, kind: str = "raw") -> Followed:
    """A followed stream's text. kind "raw" has hex lines, of which blank ones say nothing; "http" has
    lines of text, whose newlines are put back and whose blank lines count. An indented line is the server's."""
    lines = text.splitlines()
    rules = [i for i, line in enumerate(lines) if line.startswith(_RULE)]
    if not rules or rules == [len(lines) - 1]:
        raise ValueError("a followed stream has rules of === around it")
    inner = [line for line in lines[rules[0] + 1 : rules[2] if len(rules) > 2 else rules[1] if len(rules) == 2 else None] if not line.startswith(_RULE)]
    named = {line[: len(n)]: line[len(n) :].strip() for line in inner for n in _NODES if line.startswith(n)}
    body = inner[max((i + 1 for i, line in enumerate(inner) if line.startswith((*_NODES, *_HEAD))), default=0) :]
    out = []
    for line in body:
        if kind == "raw" and not line:
            continue
        from_server = line.startswith("\t")
        said = line[from_server:]
        if kind == "raw":
            try:
                data = bytes.fromhex(said.strip())
            except ValueError:
                raise ValueError(f"no hex bytes: {said!r}") from None
        else:
            data = said.encode() + b"\n"
        out.append(("server_to_client" if from_server else "client_to_server", data))
    return Followed(named.get(_NODES[0], ""), named.get(_NODES[1], ""), out)


#: Sequence numbers; a step of more than half of them is a step back. Rows or bytes in one task's stretch.
_ALL, _STRETCH = 1 << 32, 1 << 20


def reassemble(packets: DataFrame) -> DataFrame:
    """Payload segments of TCP conversations in sequence order, without retransmitted parts: capture,
    stream_key, direction (which end sent, by address and port), seq, data. Needs packets with
    src_ip and a column `payload`.

    Sequence numbers count on past 2 ** 32. Of segments that start alike the longest counts.
    Windows go over stretches of packets or bytes; a stretch hands on only where it ends, so
    a long conversation isn't one task's."""
    address, port = key_end("lo")
    from_lo = (F.col("tcp.src_port") == port) & (F.col("src_ip") == ip_text(key_family(), address))
    way, first_on = ["capture", "stream_key", "from_lo"], Window.unboundedPreceding
    sent = packets.filter("tcp is not null and octet_length(payload) > 0").select("capture", "stream_key", from_lo.alias("from_lo"), F.col("tcp.seq").alias("seq"), "payload", "packet_index", F.expr(f"packet_index div {_STRETCH}").alias("_s"))

    # Each packet's number counted on from the first one's, by the steps between packets in order.
    step = lambda now, before: F.coalesce(F.pmod(now - before + _ALL // 2, F.lit(_ALL)) - _ALL // 2, F.lit(0))
    here = Window.partitionBy(*way, "_s").orderBy("packet_index")
    sent = sent.withColumn("_step", step(F.col("seq"), F.lag("seq").over(here))).withColumn("_on", F.sum("_step").over(here.rowsBetween(first_on, 0)))
    ends = sent.groupBy(*way, "_s").agg(F.min_by("seq", "packet_index").alias("_first"), F.max_by("seq", "packet_index").alias("_last"), F.max_by("_on", "packet_index").alias("_all"))
    order = Window.partitionBy(*way).orderBy("_s")
    ends = ends.withColumn("_jump", step(F.col("_first"), F.lag("_last").over(order)))
    ends = ends.withColumn("_from", F.first("_first").over(order) + F.sum(F.col("_jump") + F.col("_all")).over(order.rowsBetween(first_on, 0)) - F.col("_all"))
    counted = sent.join(ends.select(*way, "_s", "_from"), [*way, "_s"]).withColumn("seq", F.col("_from") + F.col("_on"))

    one = counted.groupBy(*way, "seq").agg(F.max_by("payload", F.struct(F.octet_length("payload"), -F.col("packet_index"))).alias("payload"))
    one = one.withColumns({"_s": F.expr(f"seq div {_STRETCH}"), "_end": F.col("seq") + F.octet_length("payload")})
    reach = one.groupBy(*way, "_s").agg(F.max("_end").alias("_end")).withColumn("_before", F.max("_end").over(order.rowsBetween(first_on, -1))).drop("_end")
    inside = F.max("_end").over(Window.partitionBy(*way, "_s").orderBy("seq").rowsBetween(first_on, -1))
    cut = one.join(reach, [*way, "_s"]).withColumn("over", F.greatest(F.coalesce(inside, F.col("seq")), F.coalesce("_before", F.col("seq")), F.col("seq")) - F.col("seq")).filter("over < octet_length(payload)")
    return cut.select("capture", "stream_key", F.when(F.col("from_lo"), "lo_to_hi").otherwise("hi_to_lo").alias("direction"), (F.col("seq") + F.col("over")).alias("seq"), F.expr("substring(payload, cast(over as int) + 1)").alias("data"))
