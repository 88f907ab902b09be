"""Registered queries over files: the capture derived from `events` is written into the shared folder, in the format that
the query is about, and read back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import audit, streams, summaries
from .operators.http_messages import http_messages
from .operators.layer_views import VIEWS, layer_views
from .operators.dissect import dissect
from .plans.display_filter import display_filter
from .plans.filter_table import filters_of, matching, unknown_names
from .plans.scan import read_packets
from .queries import ALL_FINDINGS, FILTERS, PACKETS, events, packets
from .sources import derived, pcap
from .sources.tables import CERTIFICATE_COLUMNS, read_certificates, reassemble
from .streaming.conversations import running_conversations
from .streaming.growing import stream_frames
from .storage import Stored, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Ranges that small files are cut into as well.
RANGE_BYTES = 1 << 18


def folder(spark: SparkSession, name: str) -> str:
    out = f"{urlparse(shared_dir(spark)).path}/{name}-{uuid.uuid4().hex}"
    os.makedirs(out)
    return out


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived frames, in stretches of their order."""
    out = derived.frames_from_events(events(spark, sf_dir))
    return out.repartitionByRange(spark.sparkContext.defaultParallelism, "frame_no").sortWithinPartitions("frame_no")


def _query(name: str, sql: str | None):
    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = make
        if sql is not None:
            ORACLE_SQL[name] = PACKETS + sql
        return make

    return register


def _summed(records: DataFrame) -> DataFrame:
    """Counts of the packets by what they are, and whether each file's frames are numbered without a gap."""
    p = dissect(records.filter("packet_index is not null"), ["ts_ns", "protocol", "cap_len", "orig_len"])
    found = p.groupBy("protocol", "cap_len", "orig_len").agg(F.count(F.lit(1)).alias("packets"), F.count("ts_ns").alias("timed"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    numbers = records.groupBy("capture").agg(F.max("frame_no").alias("last"), F.count_distinct("frame_no").alias("n")).agg(F.coalesce(F.bool_and(F.col("last") + 1 == F.col("n")), F.lit(True)).alias("numbered"))
    return found.crossJoin(F.broadcast(numbers))  # one row


@_query("capture_ranges", "SELECT protocol, cap_len, orig_len, count(*) AS packets, count(*) AS timed, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, true AS numbered FROM q GROUP BY ALL")
def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = folder(spark, "ranges")
    pcap.write_pcaps(frames(spark, sf_dir), to)
    return _summed(pcap.read_capture(spark, f"{to}/*.pcap", split_bytes=RANGE_BYTES))


@_query("pcapng_round_trip", "SELECT protocol, cap_len, CASE WHEN spb THEN cap_len ELSE orig_len END AS orig_len, count(*) AS packets, count(CASE WHEN NOT spb THEN ts_ns END) AS timed, min(CASE WHEN NOT spb THEN ts_ns END) AS first_ns, max(CASE WHEN NOT spb THEN ts_ns END) AS last_ns, true AS numbered FROM (SELECT *, packet_index % 50 = 7 AS spb FROM q) GROUP BY ALL")
def _pcapng(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = folder(spark, "pcapng")
    spark.dataSource.register(pcap.CaptureSource)
    timed = F.when(F.col("frame_no") % 50 != 7, F.col("ts_ns")).alias("ts_ns")
    frames(spark, sf_dir).select(timed, "data", "orig_len", (F.col("frame_no") % 3).cast("int").alias("interface")).write.format("capture").option("resolutions", "9,6,7").mode("append").save(to)
    return _summed(pcap.read_capture(spark, f"{to}/*.pcapng", split_bytes=RANGE_BYTES))


@_query("capture_errors", """SELECT 'error' AS what, 'record of 4294967295 bytes' AS name, count(*) AS n FROM q WHERE packet_index % 211 = 210 UNION ALL SELECT 'packet', protocol, count(*) FROM q WHERE packet_index % 211 <> 210 GROUP BY protocol
    UNION ALL SELECT 'frame', '', count(*) FROM q""")
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage in the middle of captures becomes rows, and the scan goes on behind it."""
    to = folder(spark, "damaged")
    spark.dataSource.register(derived.DamagedCaptures)
    frames(spark, sf_dir).select("ts_ns", "data", "orig_len", (F.col("frame_no") % 211 == 210).alias("damaged")).write.format("damaged-capture").mode("append").save(to)
    path = f"{to}/*.pcap"
    records = pcap.scan_capture(spark, path, "PERMISSIVE", RANGE_BYTES)
    found = dissect(records, ["capture", "frame_no", "error", "packet_index", "protocol"]).withColumn("error", F.split_part("error", F.lit(" at byte"), F.lit(1)))
    kinds = Stored(spark, "damaged").put(found.groupBy("capture", "error", "protocol").agg(F.max("frame_no").alias("last"), F.count(F.lit(1)).alias("n"), F.count("packet_index").alias("packets")))
    errors = kinds.filter("error is not null").groupBy("error").agg(F.sum("n").alias("n")).select(F.lit("error").alias("what"), F.col("error").alias("name"), "n")
    packets = kinds.filter("packets > 0").groupBy("protocol").agg(F.sum("packets").alias("n")).select(F.lit("packet").alias("what"), F.col("protocol").alias("name"), "n")
    numbered = kinds.groupBy("capture").agg((F.max("last") + 1).alias("n")).agg(F.sum("n").alias("n")).select(F.lit("frame").alias("what"), F.lit("").alias("name"), "n")
    return errors.unionByName(packets).unionByName(numbered)


#: Registered filters that a scan decides a part of.
_SCANNED = ["protocol", "portpair", "string_eq", "tls_fields"]


@_query("filter_in_scan", " UNION ALL ".join(f"SELECT '{n}' AS name, protocol, count(*) AS packets, sum(ts_ns % 1000003) AS times FROM q WHERE {FILTERS[n][1]} GROUP BY protocol" for n in _SCANNED))
def _filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = folder(spark, "filtered")
    pcap.write_pcaps(frames(spark, sf_dir), to)
    out = None
    for n in _SCANNED:
        found = read_packets(spark, f"{to}/*.pcap", FILTERS[n][0], ["protocol", "ts_ns"]).groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("ts_ns") % 1_000_003).alias("times")).select(F.lit(n).alias("name"), "protocol", "packets", "times")
        out = found if out is None else out.unionByName(found)
    return out


def streamed(stream: DataFrame, to: str, mode: str) -> DataFrame:
    """What a streaming query gives until it has read all there is, with the number of each batch."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{to}/out")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{to}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{to}/out")


@_query("running_conversations", "SELECT first_index, packet_count, byte_count, first_seen_ns, last_seen_ns, tcp_flags_seen, syn_ack_seen, rst_count FROM s")
def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in an order of their own, in several batches: the state of each conversation after the last."""
    to = folder(spark, "running")
    p = packets(spark, sf_dir, " ".join(streams.STREAM_COLUMNS))
    p.repartition(4, F.xxhash64("packet_index")).write.parquet(f"{to}/in")
    rows = streamed(running_conversations(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(f"{to}/in")), to, "update")
    last = rows.groupBy("capture", "stream_key").agg(F.max_by(F.struct("*"), "batch").alias("r"))
    return last.select(*[f"r.{c}" for c in ("first_index", "packet_count", "byte_count", "first_seen_ns", "last_seen_ns", "tcp_flags_seen", "syn_ack_seen", "rst_count")])


@_query("growing_captures", "SELECT protocol, count(*) AS packets, sum(cap_len) AS bytes, min(ts_ns) AS first_ns FROM q GROUP BY protocol")
def _growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that come in two goes, each read by a run of the same streaming query."""
    to = folder(spark, "growing")
    all_frames = frames(spark, sf_dir).select("frame_no", "ts_ns", "data", "orig_len")
    out = None
    for half in (0, 1):
        spark.dataSource.register(pcap.CaptureSource)
        all_frames.filter(F.col("frame_no") % 2 == half).write.format("capture").mode("append").save(f"{to}/in")
        out = streamed(stream_frames(spark, f"{to}/in/*.pcap", split_bytes=RANGE_BYTES), to, "append")
    p = dissect(streams.with_packet_index(out.drop("batch")), ["protocol", "cap_len", "ts_ns"])
    return p.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("cap_len").alias("bytes"), F.min("ts_ns").alias("first_ns"))


#: The third capture (http_frames_from_events): its messages.
HTTP = """
WITH e AS (SELECT event_id AS i, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type = 'view'),
h AS (SELECT *, i % 3 <> 2 AS up, k * 37 % 900 AS size, i % 3 = 2 AND k % 3 = 1 AS chunked FROM e),
m AS (SELECT *, CASE WHEN up THEN 8 + length(CAST(k AS VARCHAR)) + 18 + length(CAST(u AS VARCHAR)) + 30 + length(CAST(size AS VARCHAR)) + 4 WHEN chunked THEN 17 + 26 + 28 + 2 ELSE 17 + 26 + 16 + length(CAST(size AS VARCHAR)) + 4 END AS head_len,
    CASE WHEN chunked THEN (k % 40 + 1) * 10 ELSE size END AS body_len, CASE WHEN chunked THEN (k % 40 + 1) * 15 + 5 ELSE size END AS sent FROM h),
o AS (SELECT *, coalesce(sum(head_len + sent) OVER (PARTITION BY u, up ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)
"""


def http_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dissect(derived.http_frames_from_events(events(spark, sf_dir)), ["capture", "packet_index", "src_ip", "tcp", "stream_key", "payload_at", "payload_len", "data"])
    return p.filter("payload_len > 0").withColumn("payload", F.expr("substring(data, payload_at + 1, payload_len)")).drop("data")


def _client_port() -> Column:
    return F.greatest(streams.key_end("lo")[1], streams.key_end("hi")[1])


@_query("http_messages", None)
def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations with overlapping, repeated and reordered segments whose numbers wrap."""
    got = http_messages(reassemble(http_packets(spark, sf_dir)), stretch=4096)
    return got.select(_client_port().alias("client_port"), (F.col("seq") - 4294966596).alias("start"), "is_request", "method", "uri", "status_code", "host", "content_type", "chunked", "head_len", "body_len", "complete")


ORACLE_SQL["http_messages"] = HTTP + """SELECT 49152 + u % 16384 AS client_port, CAST(start AS BIGINT) AS start, up AS is_request, CASE WHEN up THEN 'POST' END AS method, CASE WHEN up THEN concat('/p/', k) END AS uri, CASE WHEN NOT up THEN 200 END AS status_code,
    CASE WHEN up THEN concat('u', u, '.example.com') END AS host, CASE WHEN NOT up THEN 'text/plain' END AS content_type, chunked, head_len, body_len, true AS complete FROM o"""


@_query("reassembled_overlaps", None)
def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each direction after repeated and overlapping parts are left out; conversations of a client port are added up."""
    got = reassemble(http_packets(spark, sf_dir)).withColumn("answer", (F.when(F.col("direction") == "lo_to_hi", streams.key_end("lo")[1]).otherwise(streams.key_end("hi")[1])) == 80)
    whole = got.groupBy("stream_key", "answer").agg(F.sum(F.octet_length("data").cast("long")).alias("bytes"), (F.min("seq") - 4294966596).alias("first"), (F.max(F.col("seq") + F.octet_length("data")) - 4294966596).alias("past"))
    return whole.groupBy(_client_port().alias("client_port"), "answer").agg(*[F.sum(c).alias(c) for c in ("bytes", "first", "past")])


ORACLE_SQL["reassembled_overlaps"] = HTTP + "SELECT 49152 + u % 16384 AS client_port, NOT up AS answer, CAST(sum(head_len + sent) AS BIGINT) AS bytes, 0 AS first, CAST(sum(head_len + sent) AS BIGINT) AS past FROM o GROUP BY ALL"


# ---- layers as objects


def _named_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir, " ".join(["packet_index", *VIEWS]))
    each = p.select("packet_index", F.posexplode(layer_views(p)).alias("place", "layer"))
    first = lambda kind, *paths: F.coalesce(*[F.try_variant_get("layer", f"$.{path}", kind) for path in paths])
    return each.select(
        "packet_index", "place", first("string", "type").alias("type"), first("int", "source_port", "operation", "ether_type", "protocol", "next_header", "transaction_id", "status_code").alias("number"),
        first("string", "destination", "target_protocol_addr", "query_name", "uri", "sni").alias("text"), first("boolean", "flags.syn", "is_request", "is_response", "more_fragments").alias("flag"),
        first("string", "cipher_suites[1].name", "cipher_suite.name", "answers[0].data", "key_share_group.name").alias("named"),
    )


QUERIES["layer_views"] = _named_layers
ORACLE_SQL["layer_views"] = PACKETS + """SELECT packet_index, 0 AS place, 'Ethernet' AS type, CASE kind WHEN 'arp' THEN 2054 WHEN 'other' THEN 34997 WHEN 'v6' THEN 34525 ELSE 2048 END AS number, CASE WHEN up THEN '02:00:00:00:00:01' ELSE '02:00:00:00:00:02' END AS text, NULL::BOOLEAN AS flag, NULL AS named FROM q
    UNION ALL SELECT packet_index, 1, 'ARP', 1, s4, NULL, NULL FROM q WHERE kind = 'arp'
    UNION ALL SELECT packet_index, 1, CASE kind WHEN 'v4' THEN 'IPv4' ELSE 'IPv6' END, proto, dst_ip, CASE WHEN kind = 'v4' THEN false END, NULL FROM q WHERE ip
    UNION ALL SELECT packet_index, 2, CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END, src_port, NULL, CASE WHEN proto = 6 THEN flags & 2 = 2 END, NULL FROM q WHERE ip
    UNION ALL SELECT packet_index, 3, 'DNS', ident, concat(CASE WHEN u % 25 = 0 THEN concat(repeat('x', 60), '.') ELSE '' END, 'k', k, '.u', u, '.example.com'), NOT up, CASE WHEN NOT up AND rcode = 0 THEN concat('203.0.113.', k % 256) END FROM q WHERE ip AND t = 'signup'
    UNION ALL SELECT packet_index, 3, CASE WHEN up THEN 'TlsClientHello' ELSE 'TlsServerHello' END, NULL, CASE WHEN up THEN concat('s', k, '.example.net') END, NULL, CASE WHEN up THEN 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' ELSE 'TLS_AES_128_GCM_SHA256' END FROM q WHERE ip AND t = 'click'
    UNION ALL SELECT packet_index, 3, 'HTTP', CASE WHEN NOT up THEN CASE WHEN k % 7 = 0 THEN 404 ELSE 200 END END, CASE WHEN up THEN concat('/p/', k) END, up, NULL FROM q WHERE ip AND t = 'view'"""


# ---- tables of filters


def _filter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred filters, of the users' last two digits."""
    text = F.expr("concat('port ', 49152 + id, ' and frame.len > ', 60 + id, ' or nosuch.f', id, ' == 1 and tcp or ip.src == 10.0.0.', id % 16 + 1, ' and not (udp or other.name)')")
    return events(spark, sf_dir).select((F.col("user_id") % 100).cast("int").alias("id")).distinct().select("id", text.alias("text"))


@_query("filter_table", """, j AS (SELECT DISTINCT u % 100 AS j FROM q) SELECT j AS id, count(*) AS packets, sum(packet_index) AS places FROM q JOIN j ON (coalesce(49152 + j IN (src_port, dst_port), false) AND orig_len > 60 + j)
    OR (coalesce(src_ip = concat('10.0.0.', j % 16 + 1), false) AND proto <> 17) GROUP BY j""")
def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching(derived.frames_from_events(events(spark, sf_dir)), filters_of(_filter_table(spark, sf_dir)), ["packet_index"])
    return found.select(F.explode("matches").alias("id"), "packet_index").groupBy("id").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_index").alias("places"))


@_query("filter_lint", ", j AS (SELECT DISTINCT u % 100 AS j FROM q) SELECT j AS id, 0 AS place, concat('nosuch.f', j) AS name FROM j UNION ALL SELECT j, 1, 'other.name' FROM j")
def _lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_names(_filter_table(spark, sf_dir))


@_query("filter_strings", "SELECT packet_index FROM q WHERE ip AND t = 'view' AND up AND k = 7")
def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes other than of quotes and backslashes stay two characters; letters beyond ASCII are bytes."""
    text = 'http.method == "GE\\T" or http.host contains "\u00c4" or http.uri == "/p/7" and http.host contains "EXAMPLE" and http.method != "\\"GET"'
    return packets(spark, sf_dir, "packet_index http").filter(display_filter(text)).select("packet_index")


# ---- findings, texts and limits

_AUDITED = "capture packet_index ts_ns cap_len protocol src_ip dst_ip dst_port issues stream_key tcp dns"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir, _AUDITED)
    return audit.audit(streams.narrow(p, p.columns))


_query("list_findings", f"SELECT id, severity, category FROM ({ALL_FINDINGS}) WHERE severity = 'medium' AND category = 'connection_anomaly'")(lambda spark, sf_dir: audit.listed(_findings(spark, sf_dir), "MEDIUM", "Connection_Anomaly").select("id", "severity", "category"))
_query("explain_finding", f"SELECT id, severity, category FROM ({ALL_FINDINGS}) WHERE id = 'suspicious-port-23'")(lambda spark, sf_dir: audit.explained(_findings(spark, sf_dir), "suspicious-port-23").select("id", "severity", "category"))

_SIGNATURES = {1025: "rsa_pkcs1_sha256", 1027: "ecdsa_secp256r1_sha256", 2052: "rsa_pss_rsae_sha256", 9: "Unknown"}
_query("signature_names", "SELECT packet_index, CASE k % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_SIGNATURES.values())) + " END AS name FROM q")(
    lambda spark, sf_dir: derived.event_fields(events(spark, sf_dir)).select(F.col("event_id").alias("packet_index"), scalars.name_of("signature_algorithm", F.element_at(F.array(*map(F.lit, _SIGNATURES)), (F.col("k") % 4 + 1).cast("int"))).alias("name"))
)


@_query("hex_payload", "SELECT packet_index, lower(hex(concat('GET /p/', k, ' HTTP/1.1', chr(13), chr(10), 'Host: u', u, '.example.com', chr(13), chr(10), chr(13), chr(10)))) AS digits, true AS same FROM q WHERE ip AND t = 'view' AND up")
def _hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir, "packet_index http payload_at payload_len data").filter("http.is_request").withColumn("payload", F.expr("substring(data, payload_at + 1, payload_len)"))
    digits = scalars.hex_text(F.col("payload"))
    return p.select("packet_index", digits.alias("digits"), (scalars.hex_bytes(digits) == F.col("payload")).alias("same"))


@_query("packet_cap", "SELECT count(*) AS frames, true AS passed, true AS refused FROM q")
def _cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that the frames just keep, and one that they exceed."""
    all_frames = derived.frames_from_events(events(spark, sf_dir))
    n = all_frames.count()
    kept = summaries.check_limit(all_frames, n).count() == n
    try:
        summaries.check_limit(all_frames, n - 1)
        refused = False
    except ValueError:
        refused = True
    return all_frames.agg(F.count(F.lit(1)).alias("frames")).select("frames", F.lit(kept).alias("passed"), F.lit(refused).alias("refused"))


@_query("imported_certificates", "SELECT packet_index, CASE WHEN k % 3 > 0 THEN concat('cn', u) END AS common_name, CASE WHEN k % 2 = 0 THEN concat('a', k, '.example|b', u, '.example') ELSE '' END AS names FROM q WHERE packet_index % 5 = 0 AND (k % 3 > 0 OR k % 2 = 0)")
def _certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of certificates as an exporter writes it, of every fifth event, read back."""
    path = f"{shared_dir(spark)}/certificates-{uuid.uuid4().hex}"
    e = derived.event_fields(events(spark, sf_dir)).filter("event_id % 5 = 0")
    e.select(F.expr("concat_ws('\t', event_id + 1, if(k % 3 > 0, concat('cn', user_id), ''), if(k % 2 = 0, concat('a', k, '.example, b', user_id, '.example,'), ''))")).write.text(path)
    return read_certificates(spark, path).select("packet_index", "common_name", F.array_join("alternative_names", "|").alias("names"))


@_query("json_lines", """SELECT concat('{"index":', packet_index + 1, ',"protocol":"', protocol, '","source":"', source, '","stream_id":null,"length":', cap_len, CASE WHEN issue IS NOT NULL THEN concat(',"notes":"', issue, '"') ELSE '' END, '}') AS value FROM q""")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as JSON objects, written as lines and read back."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    p = packets(spark, sf_dir, "packet_index protocol source cap_len issues")
    values = {"index": F.col("packet_index") + 1, "protocol": F.col("protocol"), "source": F.col("source"), "stream_id": F.lit(None).cast("long"), "length": F.col("cap_len"), "notes": F.get("issues", F.lit(0))["kind"]}
    p.select(scalars.json_line(values, ("notes",))).write.text(path)
    return spark.read.text(path)
