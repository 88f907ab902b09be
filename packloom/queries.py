"""Registered queries over the capture derived from `events`, each with its SQL.

Queries go the long way: event fields, frame bytes, dissectors, operator. The SQL states the
operator over the event fields themselves (PACKETS below), so that equal results also
check the dissectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import audit, streams, summaries
from .operators.dissect import dissect
from .plans.display_filter import display_filter
from .plans.display_filter import filter_columns
from .sources.derived import frames_from_events, odd_frames_from_events
from .sources.pcap import read_capture, write_pcaps
from .sources.tables import read_packet_table, reassemble
from .storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PACKETS = """
WITH e AS (SELECT event_id AS i, epoch_us(CAST(ts AS TIMESTAMP)) AS us, user_id AS u, event_type AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
f AS (SELECT *, CASE WHEN i % 97 = 0 THEN 'arp' WHEN i % 101 = 0 THEN 'other' WHEN i % 103 = 0 THEN 'cut' WHEN i % 109 = 0 THEN 'v6' ELSE 'v4' END AS kind, i % 107 = 0 AS bad, i % 3 <> 2 AS up,
    (CASE WHEN u % 2 = 0 THEN u % 9 ELSE i % 9 END) + 1 AS srv, CASE WHEN t = 'signup' THEN 17 ELSE 6 END AS proto,
    CASE t WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'signup' THEN 53 WHEN 'purchase' THEN 23 ELSE 445 END AS sp, 49152 + u % 16384 AS cp, CASE WHEN i % 3 = 2 AND k < 50 THEN 3 ELSE 0 END AS rcode FROM e),
g AS (SELECT *, kind IN ('v4', 'v6') AS ip, concat('10.0.', (u // 16) % 256, '.', u % 16 + 1) AS c4, concat('198.51.100.', srv) AS s4,
    concat('2001:db8::c:', lower(to_hex(u % 65536))) AS c6, concat('2001:db8::5:', lower(to_hex(srv))) AS s6,
    CASE WHEN t = 'view' AND up THEN 41 + length(CAST(k AS VARCHAR)) + length(CAST(u AS VARCHAR))
         WHEN t = 'view' THEN CASE WHEN k % 7 = 0 THEN 22 ELSE 15 END + 2 + 23 + 2 + 16 + length(CAST(k AS VARCHAR)) + 4
         WHEN t = 'click' AND up THEN 9 + 43 + 2 + 18 + 13 + length(CAST(k AS VARCHAR)) WHEN t = 'click' THEN 63
         WHEN t = 'signup' THEN 12 + CASE WHEN u % 25 = 0 THEN 61 ELSE 0 END + 17 + length(CAST(k AS VARCHAR)) + length(CAST(u AS VARCHAR)) + 4 + CASE WHEN NOT up AND rcode = 0 THEN 16 ELSE 0 END
         ELSE 0 END AS n FROM f),
p AS (SELECT i AS packet_index, us * 1000 AS ts_ns, kind, u, k, t, up, rcode, ip, CASE WHEN ip THEN proto END AS proto, n,
    CASE WHEN ip THEN CASE WHEN kind = 'v4' THEN CASE WHEN up THEN c4 ELSE s4 END ELSE CASE WHEN up THEN c6 ELSE s6 END END END AS src_ip,
    CASE WHEN ip THEN CASE WHEN kind = 'v4' THEN CASE WHEN up THEN s4 ELSE c4 END ELSE CASE WHEN up THEN s6 ELSE c6 END END END AS dst_ip,
    CASE WHEN ip THEN CASE WHEN up THEN cp ELSE sp END END AS src_port, CASE WHEN ip THEN CASE WHEN up THEN sp ELSE cp END END AS dst_port,
    CASE WHEN kind = 'arp' THEN 'ARP' WHEN NOT ip THEN 'Unknown' WHEN t = 'view' THEN 'HTTP' WHEN t = 'click' THEN 'TLS' WHEN t = 'signup' THEN 'DNS' ELSE 'TCP' END AS protocol,
    CASE kind WHEN 'arp' THEN 42 WHEN 'other' THEN 60 WHEN 'cut' THEN 30 WHEN 'v6' THEN 54 + CASE proto WHEN 6 THEN 20 ELSE 8 END + n ELSE 34 + CASE proto WHEN 6 THEN 20 ELSE 8 END + n END AS cap_len,
    CASE kind WHEN 'arp' THEN 42 WHEN 'other' THEN 60 WHEN 'v6' THEN 54 + CASE proto WHEN 6 THEN 20 ELSE 8 END + n ELSE 34 + CASE proto WHEN 6 THEN 20 ELSE 8 END + n END AS orig_len,
    CASE WHEN kind = 'cut' THEN 'truncated' WHEN ip AND (bad OR (kind = 'v6' AND proto = 17)) THEN 'checksum_mismatch' END AS issue,
    CASE WHEN kind = 'cut' THEN 30 WHEN kind = 'v4' AND bad THEN 34 WHEN kind = 'v6' AND (bad OR proto = 17) THEN 54 END AS issue_at,
    CASE WHEN ip AND proto = 6 THEN CASE i % 16 WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 4 WHEN 3 THEN 17 ELSE CASE WHEN n > 0 THEN 24 ELSE 16 END END END AS flags,
    32 + k % 224 AS ttl, i % 65536 AS ident, (i * 1460) % 4294967296 AS seq, c4, s4 FROM g),
q AS (SELECT *, CASE WHEN kind = 'arp' THEN c4 WHEN kind = 'v4' THEN concat(src_ip, ':', src_port) WHEN kind = 'v6' THEN concat('[', src_ip, ']:', src_port) ELSE '' END AS source,
    CASE WHEN kind = 'arp' THEN s4 WHEN kind = 'v4' THEN concat(dst_ip, ':', dst_port) WHEN kind = 'v6' THEN concat('[', dst_ip, ']:', dst_port) ELSE '' END AS destination FROM p),
keyed AS (SELECT *, CASE WHEN ip THEN concat(least(source, destination), ' ', greatest(source, destination), ' ', proto) END AS skey FROM q),
s AS (SELECT skey, min(packet_index) AS first_index, row_number() OVER (ORDER BY min(packet_index)) - 1 AS stream_id, any_value(proto) AS proto, count(*) AS packet_count, sum(cap_len) AS byte_count,
    arg_min(ts_ns, packet_index) AS first_seen_ns, arg_max(ts_ns, packet_index) AS last_seen_ns, bit_or(coalesce(flags, 0)) AS tcp_flags_seen, bool_or(coalesce(flags, 0) & 18 = 18) AS syn_ack_seen,
    CAST(least(count(*) FILTER (coalesce(flags, 0) & 4 = 4), 65535) AS INTEGER) AS rst_count FROM keyed WHERE skey IS NOT NULL GROUP BY skey),
tracked AS (SELECT keyed.*, s.stream_id FROM keyed LEFT JOIN s USING (skey))
"""  # fmt: skip


#: The second capture (odd_frames_from_events).
ODD = """
WITH e AS (SELECT event_id AS i, epoch_us(CAST(ts AS TIMESTAMP)) AS us, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
t AS (SELECT i AS packet_index, i, us, u, k, i % 16 AS part, 17664 + 20 + 8 + 12 + length(concat('h', k)) + 14 + 4 + 28 + i % 65536 + 16384 + 16401 + 49152 + u % 65536 + 49152 + 513 AS total FROM e),
c AS (SELECT *, 65535 - CASE WHEN total % 65535 = 0 THEN 65535 ELSE total % 65535 END AS right_sum FROM t),
o AS (SELECT *, CASE WHEN part = 7 THEN CASE WHEN k % 3 = 0 THEN 4660 ELSE right_sum END ELSE 0 END AS header_sum,
    CASE WHEN part >= 8 THEN 'truncated' WHEN part = 7 AND k % 3 = 0 AND right_sum <> 4660 THEN 'checksum_mismatch' END AS issue, CASE WHEN part >= 8 THEN 'Unknown' END AS unknown FROM c)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table. In fewer files than there are cores, whose row groups Spark can't split, its short rows are
    spread over all of them before they become frames; in more files they stay where they are read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    return events.repartition(cores, "event_id") if len(events.inputFiles()) < cores else events


def packets(spark: SparkSession, sf_dir: str, needs: str | None = None) -> DataFrame:
    """Packets of the derived capture; needs: the columns that are decoded, all if it is None."""
    return dissect(frames_from_events(events(spark, sf_dir)), needs.split() if needs is not None else None)


def odd_packets(spark: SparkSession, sf_dir: str, needs: str) -> DataFrame:
    return dissect(odd_frames_from_events(events(spark, sf_dir)), needs.split())


def _query(name: str, sql: str | None, needs: str | None = None, source=packets, start: str = PACKETS, twice: bool = False):
    """Registers a function of packets as a query; `sql` continues `start`. needs: the columns of
    packets that it reads; twice: whether it reads them more than once."""

    def register(make: Callable[[DataFrame], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            p = source(spark, sf_dir, needs)
            return make(streams.narrow(p, p.columns) if twice else p)

        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = start + sql
        return make

    return register


def _cast(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def _line(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


# ---- decoding

_query("decode_eth_ipv4", "SELECT packet_index, 2048 AS ether_type, src_ip AS source, dst_ip AS destination, proto AS protocol, ttl, ident AS identification, true AS dont_fragment, false AS more_fragments, 0 AS fragment_offset, 0 AS header_checksum FROM q WHERE kind = 'v4'", "packet_index eth ipv4")(
    lambda p: p.filter("ipv4 is not null").select("packet_index", "eth.ether_type", "ipv4.source", "ipv4.destination", "ipv4.protocol", "ipv4.ttl", "ipv4.identification", "ipv4.dont_fragment", "ipv4.more_fragments", "ipv4.fragment_offset", "ipv4.header_checksum")
)
_query("decode_ipv6_base", "SELECT packet_index, src_ip AS source, dst_ip AS destination, proto AS next_header, 0 AS traffic_class, 0 AS flow_label, ttl AS hop_limit FROM q WHERE kind = 'v6'", "packet_index ipv6")(
    lambda p: p.filter("ipv6 is not null").select("packet_index", "ipv6.*")
)
_query("decode_tcp", "SELECT packet_index, src_port, dst_port, seq, 0 AS ack, 5 AS data_offset, flags AS flag_bits, flags & 2 = 2 AS syn, flags & 4 = 4 AS rst, 1024 AS window_size FROM q WHERE ip AND proto = 6", "packet_index tcp")(
    lambda p: p.filter("tcp is not null").select("packet_index", "tcp.src_port", "tcp.dst_port", "tcp.seq", "tcp.ack", "tcp.data_offset", "tcp.flag_bits", "tcp.flags.syn", "tcp.flags.rst", F.col("tcp.window").alias("window_size"))
)
_query("decode_udp", "SELECT packet_index, src_port, dst_port, n + 8 AS length FROM q WHERE ip AND proto = 17", "packet_index udp")(lambda p: p.filter("udp is not null").select("packet_index", "udp.*"))
_query("decode_arp", "SELECT packet_index, 1 AS operation, c4 AS sender, s4 AS target FROM q WHERE kind = 'arp'", "packet_index arp")(lambda p: p.filter("arp is not null").select("packet_index", "arp.*"))
_query(
    "decode_http",
    """SELECT packet_index, up AS is_request, CASE WHEN up THEN 'GET' END AS method, CASE WHEN up THEN concat('/p/', k) END AS uri, 'HTTP/1.1' AS version, CASE WHEN NOT up THEN CASE WHEN k % 7 = 0 THEN 404 ELSE 200 END END AS status_code,
    CASE WHEN NOT up THEN CASE WHEN k % 7 = 0 THEN 'Not Found' ELSE 'OK' END END AS reason, CASE WHEN up THEN concat('u', u, '.example.com') END AS host, CASE WHEN NOT up THEN 'text/html' END AS content_type, CASE WHEN NOT up THEN k END AS content_length FROM q WHERE ip AND t = 'view'""", "packet_index http")(lambda p: _cast(p.filter("http is not null").select("packet_index", "http.*"), content_length="long"))
_query(
    "dns_message",
    """SELECT packet_index, ident AS transaction_id, NOT up AS is_response, 0 AS opcode, rcode, 1 AS question_count, CASE WHEN NOT up AND rcode = 0 THEN 1 ELSE 0 END AS answer_count,
    concat(CASE WHEN u % 25 = 0 THEN concat(repeat('x', 60), '.') ELSE '' END, 'k', k, '.u', u, '.example.com') AS query_name, CASE WHEN k % 5 = 0 THEN 16 ELSE 1 END AS query_type,
    CASE WHEN NOT up AND rcode = 0 THEN concat('203.0.113.', k % 256) ELSE '' END AS answers FROM q WHERE ip AND t = 'signup'""", "packet_index dns")(lambda p: p.filter("dns is not null").select("packet_index", *[f"dns.{c}" for c in ("transaction_id", "is_response", "opcode", "rcode", "question_count", "answer_count", "query_name", "query_type")], F.array_join(F.transform("dns.answers", scalars.answer_text), ",").alias("answers")))
_query(
    "tls_hello",
    """SELECT packet_index, up AS client, CASE WHEN up THEN concat('s', k, '.example.net') END AS sni, CASE WHEN up THEN '4865,49199' ELSE '4865' END AS ciphers, CASE WHEN up THEN '772,771' ELSE '772' END AS versions,
    CASE WHEN up THEN 'TLS 1.0' ELSE 'TLS 1.2' END AS record, CASE WHEN NOT up THEN 'x25519' END AS key_share FROM q WHERE ip AND t = 'click'""", "packet_index protocol tls_client_hello tls_server_hello")(lambda p: p.filter("protocol = 'TLS'").select(
    "packet_index", F.col("tls_client_hello").isNotNull().alias("client"), F.col("tls_client_hello.sni").alias("sni"), F.coalesce(_line(F.col("tls_client_hello.cipher_suites")), F.col("tls_server_hello.cipher_suite").cast("string")).alias("ciphers"),
    F.coalesce(_line(F.col("tls_client_hello.supported_versions")), F.col("tls_server_hello.selected_version").cast("string")).alias("versions"),
    scalars.name_of("tls_version", F.coalesce("tls_client_hello.record_version", "tls_server_hello.record_version")).alias("record"), scalars.name_of("named_group", F.col("tls_server_hello.key_share_group")).alias("key_share"),
))
_query("decode_issues", "SELECT packet_index, 0 AS place, issue AS kind, issue_at AS \"offset\" FROM q WHERE issue IS NOT NULL", "capture packet_index issues")(lambda p: summaries.decode_issues(p).drop("capture"))
_query("checksum_validation", "SELECT packet_index, issue_at AS \"offset\" FROM q WHERE issue = 'checksum_mismatch'", "capture packet_index issues")(lambda p: summaries.decode_issues(p, "CHECKSUM_MISMATCH").select("packet_index", "offset"))
_query("layer_names", "SELECT packet_index, CASE WHEN kind = 'arp' THEN 'Ethernet,ARP' WHEN NOT ip THEN 'Ethernet' ELSE concat('Ethernet,', CASE kind WHEN 'v4' THEN 'IPv4' ELSE 'IPv6' END, CASE proto WHEN 6 THEN ',TCP' ELSE ',UDP' END, CASE WHEN protocol <> 'TCP' THEN ',' || protocol ELSE '' END) END AS layers FROM q", "packet_index layer_names")(
    lambda p: p.select("packet_index", F.array_join("layer_names", ",").alias("layers"))
)
_query(
    "layer_spans",
    """SELECT packet_index, concat('0:14', CASE WHEN kind = 'arp' THEN ',14:28' WHEN NOT ip THEN '' ELSE concat(',14:', h, ',', 14 + h, ':', w, CASE WHEN n > 0 THEN concat(',', 14 + h + w, ':', n) ELSE '' END) END) AS spans
    FROM (SELECT *, CASE kind WHEN 'v6' THEN 40 ELSE 20 END AS h, CASE proto WHEN 6 THEN 20 ELSE 8 END AS w FROM q)""", "packet_index spans")(lambda p: p.select("packet_index", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["offset"].cast("string"), s["len"].cast("string"))), ",").alias("spans")))
_query("app_dispatch", "SELECT protocol, count(*) AS packets, sum(n) AS payload_bytes FROM q WHERE ip AND protocol <> 'TCP' GROUP BY protocol", "protocol layer_names spans")(
    lambda p: p.filter("size(layer_names) = 4").groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.element_at("spans", -1)["len"].cast("long")).alias("payload_bytes"))
)

# ---- display filters, with what they mean in SQL

_SHOWN = ["packet_index", "protocol", "source", "destination"]
FILTERS = {
    "protocol": ("tcp and not tls", "ip AND proto = 6 AND protocol <> 'TLS'"),
    "int_cmp": ("ip.ttl >= 100 and frame.len < 90 or tcp.window != 1024", "kind = 'v4' AND ttl >= 100 AND orig_len < 90"),
    "addr": ("ip.src == 198.51.100.3 or ip.dst != 2001:db8::5:1 and ipv6", "coalesce(src_ip = '198.51.100.3', false) OR (kind = 'v6' AND dst_ip <> '2001:db8::5:1')"),
    "cidr": ("ip.src == 10.0.4.0/22 or ip.dst != 0.0.0.0/0", "kind = 'v4' AND src_ip LIKE '10.0.%' AND CAST(split_part(src_ip, '.', 3) AS INTEGER) BETWEEN 4 AND 7"),
    "bool": ("tcp.flags.syn == true and tcp.flags.ack != true or ip.flags.df == false", "ip AND flags & 18 = 2"),
    "portpair": ("tcp.port == 443", "ip AND proto = 6 AND 443 IN (src_port, dst_port)"),
    "portpair_ne": ("tcp.port != 443", "ip AND proto = 6 AND src_port <> 443 AND dst_port <> 443"),
    "contains": ('dns.qname contains "K1" or ip.src contains "100.2"', "(ip AND t = 'signup' AND concat('k', k, '.u', u, '.example.com') LIKE '%k1%') OR coalesce(src_ip LIKE '%100.2%', false)"),
    "matches": (r'http.uri matches "^/p/[0-9]{2}$" or tls.sni matches "s\\d\\."', "ip AND up AND ((t = 'view' AND k BETWEEN 10 AND 99) OR (t = 'click' AND k BETWEEN 0 AND 9))"),
    "not_missing": ("not (dns.rcode == 3) and not tcp.flags.rst", "NOT (ip AND t = 'signup' AND rcode = 3) AND NOT coalesce(ip AND flags & 4 = 4, false)"),
    "shorthand": ("port 53 and host 10.0.0.0/24 or src 2001:db8::c:a", "(coalesce(53 IN (src_port, dst_port), false) AND kind = 'v4' AND (src_ip LIKE '10.0.0.%' OR dst_ip LIKE '10.0.0.%')) OR coalesce(src_ip = '2001:db8::c:a', false)"),
    "bare_field": ("dns.answer or tcp.flags.fin or arp.opcode", "(ip AND t = 'signup' AND NOT up AND rcode = 0) OR coalesce(ip AND flags & 1 = 1, false) OR kind = 'arp'"),
    "type_mismatch": ('ip.ttl == "64" or dns.qname > "a" or ip.src > 10.0.0.1 or nosuch.field == 1 or not (udp.length == "8") and udp', "ip AND proto = 17"),
    "string_eq": ('http.method == "GET" and http.host != "u1.example.com"', "ip AND t = 'view' AND up AND u <> 1"),
    "tls_fields": ("tls.handshake.type == 2 and tls.selected_version == 0x0304 and tls.cipher_suite == 4865", "ip AND t = 'click' AND NOT up"),
    "nested": ("not not (udp or (tcp and (port 23 or port 445)))", "ip AND (proto = 17 OR 23 IN (src_port, dst_port) OR 445 IN (src_port, dst_port))"),
}
for _name, (_text, _where) in FILTERS.items():
    _query(f"filter_{_name}", f"SELECT packet_index, protocol, source, destination FROM q WHERE {_where}", " ".join({*_SHOWN, *filter_columns(_text)}))(lambda p, text=_text: p.filter(display_filter(text)).select(*_SHOWN))
_query("filter_stream", "SELECT packet_index, protocol, source, destination FROM tracked WHERE proto = 6 AND stream_id < 40", " ".join({*streams.STREAM_COLUMNS, *_SHOWN}), twice=True)(
    lambda p: streams.with_stream_id(p).filter(display_filter("tcp.stream < 40")).select(*_SHOWN)
)

# ---- summaries

_query("summary_rows", "SELECT packet_index, ts_ns, protocol, source, destination, cap_len, orig_len, issue IS NOT NULL AS has_issues FROM q", "packet_index ts_ns protocol source destination cap_len orig_len issues")(lambda p: p.select("packet_index", "ts_ns", "protocol", "source", "destination", "cap_len", "orig_len", (F.size("issues") > 0).alias("has_issues")))
_query("protocol_counts", "SELECT protocol, count(*) AS packets FROM q GROUP BY protocol", "protocol")(summaries.protocol_counts)
_query("protocol_percent", "SELECT protocol, count(*) AS packets, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM q GROUP BY protocol", "protocol")(lambda p: summaries.protocol_percent(p).withColumn("percent", F.round(F.col("percent").cast("double"), 6)))
_ENDS = "ends AS (SELECT e AS endpoint FROM (SELECT source AS e FROM q UNION ALL SELECT destination FROM q) WHERE e <> '')"
_query("endpoint_counts", f", {_ENDS} SELECT endpoint, count(*) AS packets FROM ends GROUP BY endpoint", "source destination")(summaries.endpoint_counts)
_query("top_endpoints", f", {_ENDS} SELECT endpoint, count(*) AS packets FROM ends GROUP BY endpoint ORDER BY packets DESC, endpoint LIMIT 10", "source destination")(summaries.top_endpoints)
_query("host_counts", ", h AS (SELECT coalesce(src_ip, CASE WHEN kind = 'arp' THEN c4 END) AS host FROM q UNION ALL SELECT coalesce(dst_ip, CASE WHEN kind = 'arp' THEN s4 END) FROM q) SELECT host, count(*) AS packets FROM h WHERE host IS NOT NULL GROUP BY host", "source destination")(summaries.host_counts)
_query("port_counts", ", h AS (SELECT src_port AS port FROM q UNION ALL SELECT dst_port FROM q) SELECT port, count(*) AS packets FROM h WHERE port IS NOT NULL GROUP BY port", "source destination")(summaries.port_counts)
_query("capture_stats", "SELECT count(*) AS packet_count, count(DISTINCT skey) AS stream_count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, (max(ts_ns) - min(ts_ns)) / 1e9 AS duration_s FROM keyed", "capture ts_ns stream_key")(summaries.capture_stats)
_query("capture_summary", "SELECT count(*) AS packet_count, count(DISTINCT skey) AS stream_count, arg_min(ts_ns, packet_index) AS first_ns, arg_max(ts_ns, packet_index) AS last_ns, greatest(0, (arg_max(ts_ns, packet_index) - arg_min(ts_ns, packet_index)) // 1000000) AS duration_ms FROM keyed", "capture packet_index ts_ns stream_key")(summaries.capture_summary)
_query("issue_counts", "SELECT count(issue) AS issues, count(issue) AS packets_with_issues FROM q", "issues")(summaries.issue_total)

# ---- conversations

_query("stream_ids", "SELECT packet_index, stream_id FROM tracked", "capture packet_index ts_ns cap_len stream_key tcp", twice=True)(lambda p: streams.with_stream_id(p).select("packet_index", "stream_id"))
_query("stream_metadata", "SELECT stream_id, packet_count, byte_count, first_seen_ns, last_seen_ns, tcp_flags_seen, syn_ack_seen, rst_count FROM s", "capture packet_index ts_ns cap_len stream_key tcp")(lambda p: streams.streams(p).select("stream_id", "packet_count", "byte_count", "first_seen_ns", "last_seen_ns", "tcp_flags_seen", "syn_ack_seen", "rst_count"))
_query("stream_packets", "SELECT packet_index, source, destination, cap_len FROM tracked WHERE stream_id = 7", "capture packet_index ts_ns cap_len stream_key tcp source destination", twice=True)(lambda p: streams.stream_packets(p, 7).select("packet_index", "source", "destination", "cap_len"))
_query("list_streams_page", "SELECT stream_id, CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, packet_count, byte_count, greatest(0, (last_seen_ns - first_seen_ns) // 1000000) AS duration_ms FROM s ORDER BY stream_id LIMIT 50 OFFSET 20", "capture packet_index ts_ns cap_len stream_key tcp")(
    lambda p: summaries.page(streams.describe_streams(streams.streams(p)), ["stream_id"], 20, 50).select("stream_id", "protocol", "packet_count", "byte_count", "duration_ms")
)
_query("stream_endpoints", "SELECT stream_id, least(min(source), min(destination)) AS one, greatest(max(source), max(destination)) AS other FROM tracked WHERE stream_id IS NOT NULL GROUP BY stream_id", "capture packet_index ts_ns cap_len stream_key tcp")(
    lambda p: streams.describe_streams(streams.streams(p)).select("stream_id", F.least("endpoint_a", "endpoint_b").alias("one"), F.greatest("endpoint_a", "endpoint_b").alias("other"))
)

# ---- lists and searches

_query("list_packets_page", "SELECT packet_index, protocol, source, destination FROM q ORDER BY packet_index LIMIT 1000 OFFSET 500", "packet_index protocol source destination")(lambda p: summaries.page(p, ["packet_index"], 500, 5000).select(*_SHOWN))
_query("get_packet", "SELECT packet_index, protocol, source, destination FROM q WHERE packet_index = 42", "packet_index protocol source destination")(lambda p: p.filter("packet_index = 42").select(*_SHOWN))
_query("search_cli", "SELECT packet_index, protocol, source, destination FROM q WHERE protocol IN ('DNS', 'TLS') AND source LIKE '%10.0.%' AND 'ethernet' LIKE '%net%'", "packet_index protocol source destination layer_names")(lambda p: summaries.search(p.filter("protocol in ('DNS', 'TLS')"), source="10.0.", text="NET").select(*_SHOWN))
_query("search_exact", "SELECT packet_index, protocol, source, destination FROM q WHERE protocol = 'HTTP' AND 80 IN (src_port, dst_port) AND issue IS NULL", "packet_index protocol source destination src_port dst_port issues")(lambda p: summaries.search(p, protocol="http", port=80, has_issues=False, exact=True).select(*_SHOWN))
_query("search_with_filter", "SELECT packet_index, protocol, source, destination FROM q WHERE issue IS NOT NULL AND ip AND proto = 6", "packet_index protocol source destination issues tcp")(lambda p: summaries.search(p, has_issues=True, matching=display_filter("tcp")).select(*_SHOWN))

# ---- audit

_FINDING = ["id", "severity", "category", "title"]
_AUDIT = {
    "audit_decode_ratio": (audit.decode_issue_ratio, "SELECT 'decode-issues' AS id, 'high' AS severity, 'decode_issues' AS category, 'Decode issues affect a large share of packets' AS title FROM (SELECT count(issue) AS a, count(*) AS b FROM o) WHERE b > 0 AND a / b >= 0.5"),
    "audit_unknown_ratio": (audit.unknown_ratio, "SELECT 'unknown-traffic' AS id, 'medium' AS severity, 'unknown_traffic' AS category, 'Unknown traffic dominates the capture' AS title FROM (SELECT count(unknown) AS a, count(*) AS b FROM o) WHERE b > 0 AND a / b >= 0.5"),
    "audit_scan": (audit.scan_activity, "SELECT concat('scan-activity-', src_ip) AS id, 'high' AS severity, 'scan_activity' AS category, concat('Endpoint fan-out from ', src_ip, ' looks scan-like') AS title FROM q WHERE ip GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 5"),
    "audit_suspicious_ports": (audit.suspicious_ports, "SELECT concat('suspicious-port-', dst_port) AS id, 'medium' AS severity, 'suspicious_ports' AS category, concat('Traffic observed on suspicious destination port ', dst_port) AS title FROM q WHERE dst_port IN (23, 445, 2323, 3389, 5900) GROUP BY dst_port"),
    "audit_cleartext": (audit.cleartext, "SELECT concat('cleartext-', lower(n)) AS id, 'high' AS severity, 'cleartext_credentials' AS category, concat(n, ' traffic on port ', dst_port, ' may expose credentials in cleartext') AS title FROM (SELECT DISTINCT dst_port, CASE dst_port WHEN 23 THEN 'Telnet' ELSE 'HTTP' END AS n FROM q WHERE dst_port IN (23, 80))"),
    "audit_dns_tunnel": (audit.dns_tunneling, "SELECT concat('dns-tunneling-', src_ip) AS id, 'high' AS severity, 'dns_tunneling' AS category, concat('Possible DNS tunneling activity from ', src_ip) AS title FROM q WHERE ip AND t = 'signup' GROUP BY src_ip HAVING count(DISTINCT concat(k, '.', u)) > 50 OR count(*) FILTER (u % 25 = 0) > 0 OR count(*) FILTER (k % 5 = 0) > 10"),
    "audit_nxdomain": (audit.nxdomain_storm, "SELECT 'nxdomain-storm' AS id, 'high' AS severity, 'dns_anomaly' AS category, concat('High NXDOMAIN rate: ', c, ' responses with RCODE 3 (possible DGA/malware)') AS title FROM (SELECT least(count(*), 100) AS c FROM q WHERE ip AND t = 'signup' AND NOT up AND rcode = 3) WHERE c >= 20"),
    "audit_conn_anomaly": (audit.connection_anomalies, None),
}
_CONN = """SELECT id, sev AS severity, 'connection_anomaly' AS category FROM (
    SELECT concat('incomplete-handshake-', stream_id) AS id, 'medium' AS sev FROM s WHERE proto = 6 AND tcp_flags_seen & 2 <> 0 AND NOT syn_ack_seen
    UNION ALL SELECT concat('rst-storm-', stream_id), 'medium' FROM s WHERE proto = 6 AND rst_count >= 3
    UNION ALL SELECT concat('half-open-', stream_id), 'low' FROM s WHERE proto = 6 AND tcp_flags_seen & 18 = 18 AND tcp_flags_seen & 5 = 0 AND packet_count >= 10)"""
_READ = {
    "audit_scan": "src_ip dst_ip", "audit_suspicious_ports": "dst_port", "audit_cleartext": "dst_port", "audit_dns_tunnel": "src_ip dns", "audit_nxdomain": "dns", "audit_decode_ratio": "issues", "audit_unknown_ratio": "protocol",
}
for _name, (_rule, _sql) in _AUDIT.items():
    if _sql is not None:
        _odd = _name in ("audit_decode_ratio", "audit_unknown_ratio")  # these fire in the second capture alone
        _query(_name, _sql, "capture packet_index " + _READ[_name], odd_packets if _odd else packets, ODD if _odd else PACKETS, twice=_name != "audit_nxdomain")(lambda p, rule=_rule: rule(p).select(*_FINDING))
_query("audit_conn_anomaly", _CONN, "capture packet_index ts_ns cap_len stream_key tcp", twice=True)(lambda p: audit.connection_anomalies(p).select("id", "severity", "category"))
_ALL = "SELECT id, severity, category FROM ({}) UNION ALL ".format(") UNION ALL SELECT id, severity, category FROM (".join(_AUDIT[n][1] for n in ("audit_scan", "audit_suspicious_ports", "audit_cleartext", "audit_dns_tunnel", "audit_nxdomain"))) + _CONN
#: The findings of all rules: continues PACKETS.
ALL_FINDINGS = _ALL
_query("audit_all_findings", _ALL, "capture packet_index ts_ns cap_len protocol src_ip dst_ip dst_port issues stream_key tcp dns")(lambda p: audit.audit(p).select("id", "severity", "category"))
_query("audit_severity_tally", f"SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity NOT IN ('high', 'medium')) AS low FROM ({_ALL})", "capture packet_index ts_ns cap_len protocol src_ip dst_ip dst_port issues stream_key tcp dns")(lambda p: audit.severity_tally(audit.audit(p)))
_query(
    "audit_evidence",
    """SELECT concat('suspicious-port-', dst_port) AS id, string_agg(packet_index, ',' ORDER BY packet_index) AS packets FROM (SELECT dst_port, packet_index, row_number() OVER (PARTITION BY dst_port ORDER BY packet_index) AS r FROM q WHERE dst_port IN (23, 445, 2323, 3389, 5900)) WHERE r <= 100 GROUP BY dst_port
    UNION ALL SELECT concat('scan-activity-', src_ip), string_agg(packet_index, ',' ORDER BY r) FROM (SELECT src_ip, packet_index, row_number() OVER (PARTITION BY src_ip ORDER BY rn > 1, dst_ip, packet_index) AS r FROM (SELECT src_ip, dst_ip, packet_index, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY packet_index) AS rn FROM q WHERE ip AND src_ip IN (SELECT src_ip FROM q WHERE ip GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 5)) WHERE rn <= 100) WHERE r <= 100 GROUP BY src_ip""", "capture packet_index src_ip dst_ip dst_port", twice=True)(lambda p: audit.suspicious_ports(p).unionByName(audit.scan_activity(p)).select("id", _line(F.col("packet_indexes")).alias("packets")))

# ---- comparison of two captures: TCP packets, and all others


def _parts(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    return p.filter("array_contains(layer_names, 'TCP')"), p.filter("not array_contains(layer_names, 'TCP')")


_TCP = "(SELECT * FROM keyed WHERE ip AND proto = 6)"
_REST = "(SELECT * FROM keyed WHERE NOT ip OR proto <> 6)"
_ONLY = ", a AS ({a}), b AS ({b}) SELECT 'only_a' AS side, key, count(*) AS packets FROM a WHERE key NOT IN (SELECT key FROM b) GROUP BY key UNION ALL SELECT 'only_b', key, count(*) FROM b WHERE key NOT IN (SELECT key FROM a) GROUP BY key"
_HOSTS = "SELECT coalesce(src_ip, CASE WHEN kind = 'arp' THEN c4 END) AS key FROM {t} WHERE ip OR kind = 'arp' UNION ALL SELECT coalesce(dst_ip, CASE WHEN kind = 'arp' THEN s4 END) FROM {t} WHERE ip OR kind = 'arp'"
_PORTS = "SELECT CAST(src_port AS VARCHAR) AS key FROM {t} WHERE ip UNION ALL SELECT CAST(dst_port AS VARCHAR) FROM {t} WHERE ip"
_PROTOCOLS = "SELECT protocol AS key FROM {t}"
for _name, _keys, _kind in (("compare_hosts", _HOSTS, "host"), ("compare_ports", _PORTS, "port"), ("compare_protocols", _PROTOCOLS, "protocol")):
    _query(_name, _ONLY.format(a=_keys.format(t=_TCP), b=_keys.format(t=_REST)), "capture layer_names " + ("protocol" if _kind == "protocol" else "source destination"), twice=True)(lambda p, kind=_kind: summaries.compare(*_parts(p), (kind,)).select("side", "key", "packets"))
_query("compare_deltas", f"SELECT packets_a, packets_b, packets_b - packets_a AS packet_delta, streams_a, streams_b, streams_b - streams_a AS stream_delta FROM (SELECT count(*) AS packets_a, count(DISTINCT skey) AS streams_a FROM {_TCP}), (SELECT count(*) AS packets_b, count(DISTINCT skey) AS streams_b FROM {_REST})", "capture layer_names stream_key", twice=True)(lambda p: summaries.compare_deltas(*_parts(p)))

# ---- scalar functions

_query("fmt_timestamp", "SELECT packet_index, concat(strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST((ts_ns // 1000000) % 1000 AS VARCHAR), 3, '0'), 'Z') AS utc FROM q", "packet_index ts_ns")(lambda p: p.select("packet_index", scalars.utc_text(F.col("ts_ns")).alias("utc")))
_query("fmt_mac", "SELECT packet_index, CASE WHEN up THEN '02:00:00:00:00:01' ELSE '02:00:00:00:00:02' END AS destination FROM q", "packet_index eth")(lambda p: p.select("packet_index", "eth.destination"))
_query("extract_host_port", "SELECT packet_index, coalesce(src_ip, CASE WHEN kind = 'arp' THEN c4 ELSE '' END) AS host, src_port AS port FROM q", "packet_index source")(lambda p: p.select("packet_index", scalars.host_of(F.col("source")).alias("host"), scalars.port_of(F.col("source")).alias("port")))
_query("fmt_endpoint", "SELECT packet_index, coalesce(source, '') AS endpoint FROM q WHERE ip", "packet_index src_ip src_port")(lambda p: p.filter("src_ip is not null").select("packet_index", scalars.with_port(F.col("src_ip"), F.col("src_port")).alias("endpoint")))
_query(
    "name_lookups",
    """SELECT packet_index, CASE kind WHEN 'arp' THEN 'ARP' WHEN 'other' THEN 'Unknown' WHEN 'v6' THEN 'IPv6' ELSE 'IPv4' END AS ether, CASE WHEN kind = 'v4' THEN CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END END AS ip, CASE WHEN ip AND t = 'signup' THEN CASE WHEN k % 5 = 0 THEN 'TXT' ELSE 'A' END END AS qtype,
    CASE WHEN ip AND t = 'signup' THEN CASE rcode WHEN 3 THEN 'NXDOMAIN' ELSE 'No Error' END END AS rcode, CASE WHEN ip AND t = 'click' AND NOT up THEN 'TLS_AES_128_GCM_SHA256' END AS cipher FROM q""", "packet_index eth ipv4 dns tls_server_hello")(lambda p: p.select("packet_index", *[scalars.name_of(kind, F.col(c)).alias(a) for a, kind, c in (("ether", "ether_type", "eth.ether_type"), ("ip", "ip_protocol", "ipv4.protocol"), ("qtype", "dns_qtype", "dns.query_type"), ("rcode", "dns_rcode", "dns.rcode"), ("cipher", "cipher_suite", "tls_server_hello.cipher_suite"))]))
_query(
    "summary_lines",
    """SELECT packet_index, printf('%4d  %-24s  %-5s  %-22s -> %-22s %4d', packet_index + 1, concat(strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST((ts_ns // 1000000) % 1000 AS VARCHAR), 3, '0'), 'Z'), protocol, source, destination, cap_len) AS line FROM q""",
    "packet_index ts_ns protocol source destination cap_len",
)(lambda p: p.select("packet_index", (F.col("packet_index") + 1).alias("number"), scalars.utc_text(F.col("ts_ns")).alias("time"), "protocol", "source", "destination", "cap_len").select("packet_index", scalars.summary_line().alias("line")))

# ---- the second capture


def _odd(name: str, sql: str, needs: str):
    return _query(name, sql, needs, odd_packets, ODD)


_odd(
    "decode_icmp",
    """SELECT packet_index, CASE part WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 11 END AS type, CASE part WHEN 1 THEN 4 ELSE 0 END AS code, CASE part WHEN 0 THEN 'EchoRequest' WHEN 1 THEN 'DestinationUnreachable' END AS kind,
    CASE part WHEN 0 THEN u % 65536 END AS identifier, CASE part WHEN 0 THEN i % 65536 END AS sequence, CASE part WHEN 1 THEN 576 + k END AS next_hop_mtu, CASE part WHEN 0 THEN 'Echo Request' WHEN 1 THEN 'Destination Unreachable' ELSE 'Time Exceeded' END AS name FROM o WHERE part <= 2""",
    "packet_index icmp",
)(lambda p: p.filter("icmp is not null").select("packet_index", "icmp.type", "icmp.code", "icmp.detail.kind", "icmp.detail.identifier", "icmp.detail.sequence", "icmp.detail.next_hop_mtu", scalars.name_of("icmp_type", F.col("icmp.type")).alias("name")))
_odd("decode_fragments", "SELECT packet_index, CASE part WHEN 4 THEN 16 ELSE 0 END AS fragment_offset, part = 3 AS more_fragments, false AS dont_fragment, CASE part WHEN 3 THEN 'Ethernet,IPv4,UDP' ELSE 'Ethernet,IPv4' END AS layers FROM o WHERE part IN (3, 4)", "packet_index ipv4 layer_names")(
    lambda p: p.filter("ipv4.more_fragments or ipv4.fragment_offset > 0").select("packet_index", "ipv4.fragment_offset", "ipv4.more_fragments", "ipv4.dont_fragment", F.array_join("layer_names", ",").alias("layers"))
)
_odd(
    "decode_ipv6_extensions",
    """SELECT packet_index, CASE part WHEN 5 THEN 0 ELSE 44 END AS next_header, CASE WHEN u % 65536 = 0 THEN '2001:db8::' ELSE concat('2001:db8::', lower(to_hex(u % 65536))) END AS src_ip, CASE part WHEN 5 THEN 'Ethernet,IPv6,TCP' ELSE 'Ethernet,IPv6' END AS layers,
    CASE part WHEN 5 THEN '0:14,14:48,62:20' ELSE '0:14,14:48' END AS spans, CASE part WHEN 5 THEN i END AS seq FROM o WHERE part IN (5, 6)""",
    "packet_index src_ip ipv6 tcp layer_names spans",
)(lambda p: p.filter("ipv6 is not null").select(
    "packet_index", "ipv6.next_header", "src_ip", F.array_join("layer_names", ",").alias("layers"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["offset"].cast("string"), s["len"].cast("string"))), ",").alias("spans"), "tcp.seq",
))
_odd("ipv4_checksum", "SELECT packet_index, header_sum AS header_checksum, issue IS NOT NULL AS wrong FROM o WHERE part <= 4 OR part = 7", "packet_index ipv4 issues")(
    lambda p: p.filter("ipv4 is not null").select("packet_index", "ipv4.header_checksum", F.exists("issues", lambda x: (x["kind"] == "checksum_mismatch") & (x["offset"] == 14)).alias("wrong"))
)
_odd(
    "dns_aaaa",
    """SELECT packet_index, concat('h', k, '.example.com') AS query_name, 28 AS query_type, concat('h', k, '.example.com') AS answer_name, 28 AS record_type, 300 AS ttl,
    CASE WHEN u = 0 THEN '2001:db8::' WHEN u < 65536 THEN concat('2001:db8::', lower(to_hex(u))) ELSE concat('2001:db8::', lower(to_hex(u // 65536)), ':', lower(to_hex(u % 65536))) END AS address FROM o WHERE part = 7""",
    "packet_index dns",
)(lambda p: p.select("packet_index", "dns.query_name", "dns.query_type", F.explode("dns.answers").alias("a")).select("packet_index", "query_name", "query_type", F.col("a.name").alias("answer_name"), "a.record_type", "a.ttl", F.col("a.data.addr").alias("address")))
_odd("odd_issues", "SELECT packet_index, 0 AS place, issue AS kind, CASE issue WHEN 'truncated' THEN 30 ELSE 14 END AS \"offset\" FROM o WHERE issue IS NOT NULL", "capture packet_index issues")(lambda p: summaries.decode_issues(p).drop("capture"))
_odd("odd_protocols", "SELECT CASE WHEN part <= 2 THEN 'ICMP' WHEN part = 3 THEN 'UDP' WHEN part = 4 THEN 'IPv4' WHEN part = 5 THEN 'TCP' WHEN part = 6 THEN 'IPv6' WHEN part = 7 THEN 'DNS' ELSE 'Unknown' END AS protocol, count(*) AS packets FROM o GROUP BY 1", "protocol")(summaries.protocol_counts)
_odd("filter_icmp", "SELECT packet_index, CASE part WHEN 5 THEN 'TCP' ELSE 'ICMP' END AS protocol FROM o WHERE part IN (1, 5)", "packet_index protocol icmp ipv6 tcp")(lambda p: p.filter(display_filter("icmp.type == 3 and icmp.code == 4 or ipv6.nxt == 0 and tcp")).select("packet_index", "protocol"))

# ---- whole texts of findings

_SAID = ["id", "title", "summary", "description"]
_query(
    "finding_texts",
    """SELECT concat('scan-activity-', src_ip) AS id, concat('Endpoint fan-out from ', src_ip, ' looks scan-like') AS title, concat(src_ip, ' contacted ', n, ' distinct destinations in a single capture.') AS summary, concat('Observed fan-out to ', n, ' unique destination hosts.') AS description
        FROM (SELECT src_ip, count(DISTINCT dst_ip) AS n FROM q WHERE ip GROUP BY src_ip) WHERE n >= 5
    UNION ALL SELECT concat('suspicious-port-', dst_port), concat('Traffic observed on suspicious destination port ', dst_port), concat('The capture includes packets targeting destination port ', dst_port, ', which commonly appears in audit findings.'), concat('Packets targeted destination port ', dst_port, '.')
        FROM (SELECT DISTINCT dst_port FROM q WHERE dst_port IN (23, 445, 2323, 3389, 5900))
    UNION ALL SELECT concat('cleartext-', lower(n)), concat(n, ' traffic on port ', dst_port, ' may expose credentials in cleartext'),
        concat(n, ' transmits data without encryption. Credentials, session tokens, and other sensitive information sent over port ', dst_port, ' can be intercepted by anyone with network access.'), concat('Packets targeted ', n, ' destination port ', dst_port, '.')
        FROM (SELECT DISTINCT dst_port, CASE dst_port WHEN 23 THEN 'Telnet' ELSE 'HTTP' END AS n FROM q WHERE dst_port IN (23, 80))
    UNION ALL SELECT concat('dns-tunneling-', src_ip), concat('Possible DNS tunneling activity from ', src_ip),
        concat('DNS traffic from ', src_ip, ' exhibits indicators of tunneling: ', concat_ws('; ', CASE WHEN a > 50 THEN concat(a, ' unique query names (threshold: 50)') END, CASE WHEN b > 0 THEN concat(b, ' queries with labels longer than 50 characters') END, CASE WHEN c > 10 THEN concat(c, ' TXT queries (threshold: 10)') END), '.'), concat('DNS queries from ', src_ip, ' with tunneling indicators.')
        FROM (SELECT src_ip, count(DISTINCT concat(k, '.', u)) AS a, count(*) FILTER (u % 25 = 0) AS b, count(*) FILTER (k % 5 = 0) AS c FROM q WHERE ip AND t = 'signup' GROUP BY src_ip) WHERE a > 50 OR b > 0 OR c > 10
    UNION ALL SELECT 'nxdomain-storm', concat('High NXDOMAIN rate: ', c, ' responses with RCODE 3 (possible DGA/malware)'), concat('The capture contains ', c, ' DNS responses with RCODE NXDOMAIN, which may indicate domain generation algorithm (DGA) activity, malware beaconing to non-existent domains, or DNS enumeration.'), concat(c, ' NXDOMAIN responses observed.')
        FROM (SELECT least(count(*), 100) AS c FROM q WHERE ip AND t = 'signup' AND NOT up AND rcode = 3) WHERE c >= 20""",
    "capture packet_index src_ip dst_ip dst_port dns",
    twice=True,
)(lambda p: audit.scan_activity(p).unionByName(audit.suspicious_ports(p)).unionByName(audit.cleartext(p)).unionByName(audit.dns_tunneling(p)).unionByName(audit.nxdomain_storm(p)).select(*_SAID))
_query(
    "connection_finding_texts",
    """SELECT concat('incomplete-handshake-', stream_id) AS id, concat('Stream ', stream_id, ' contains a SYN but no SYN+ACK was observed, indicating an incomplete TCP handshake.') AS summary, concat('Packets from stream ', stream_id, ' with incomplete handshake.') AS description, NULL AS rst_title FROM s WHERE proto = 6 AND tcp_flags_seen & 2 <> 0 AND NOT syn_ack_seen
    UNION ALL SELECT concat('rst-storm-', stream_id), concat('Stream ', stream_id, ' contains ', rst_count, ' RST packets, which may indicate a connection teardown storm or port scanning.'), concat('Packets from stream ', stream_id, ' exhibiting RST storm behavior.'), concat('RST storm on stream ', stream_id, ' (', rst_count, ' RST packets)') FROM s WHERE proto = 6 AND rst_count >= 3
    UNION ALL SELECT concat('half-open-', stream_id), concat('Stream ', stream_id, ' exchanged ', packet_count, ' packets after the handshake but was never closed with FIN or RST.'), concat('Packets from stream ', stream_id, ' with no connection teardown.'), NULL FROM s WHERE proto = 6 AND tcp_flags_seen & 18 = 18 AND tcp_flags_seen & 5 = 0 AND packet_count >= 10""",
    "capture packet_index ts_ns cap_len stream_key tcp",
    twice=True,
)(lambda p: audit.connection_anomalies(p).select("id", "summary", "description", F.when(F.col("id").startswith("rst"), F.col("title")).alias("rst_title")))
_odd(
    "ratio_finding_texts",
    """SELECT 'decode-issues' AS id, 'Decode issues affect a large share of packets' AS title, 'Packets contain malformed or truncated decode results that may indicate capture corruption or evasive traffic.' AS summary, concat('decode_issues affected ', CAST(round_even(a / b * 100, 0) AS BIGINT), '% of packets in the capture.') AS description FROM (SELECT count(issue) AS a, count(*) AS b FROM o) WHERE a / b >= 0.5
    UNION ALL SELECT 'unknown-traffic', 'Unknown traffic dominates the capture', 'A large portion of packets could not be classified beyond the link layer, which reduces audit confidence.', concat('unknown_traffic affected ', CAST(round_even(a / b * 100, 0) AS BIGINT), '% of packets in the capture.') FROM (SELECT count(unknown) AS a, count(*) AS b FROM o) WHERE a / b >= 0.5""",
    "capture packet_index ts_ns cap_len protocol src_ip dst_ip dst_port issues stream_key tcp dns",
)(lambda p: audit.audit(p, "quality").select(*_SAID))

# ---- more lists, texts and files

_query("search_destination", "SELECT packet_index, protocol, source, destination FROM q WHERE destination LIKE '%198.51.100.1%'", "packet_index protocol source destination")(lambda p: summaries.search(p, destination="198.51.100.1").select(*_SHOWN))
_query(
    "describe_capture",
    f""", {_ENDS} SELECT 'packets' AS what, '' AS name, count(*) AS n FROM q UNION ALL SELECT 'issues', '', count(issue) FROM q UNION ALL SELECT 'protocol', protocol, count(*) FROM q GROUP BY protocol
    UNION ALL SELECT 'endpoint', endpoint, packets FROM (SELECT endpoint, count(*) AS packets FROM ends GROUP BY endpoint ORDER BY packets DESC, endpoint LIMIT 10)""",
    "protocol source destination issues",
    twice=True,
)(summaries.description)
_query(
    "findings_escalated",
    "SELECT concat('scan-activity-', src_ip) AS id, n >= 9 AS escalated, CASE WHEN n >= 9 THEN concat('reached ', n) END AS notes FROM (SELECT src_ip, count(DISTINCT dst_ip) AS n FROM q WHERE ip GROUP BY src_ip) WHERE n >= 5",
    "capture packet_index src_ip dst_ip",
    twice=True,
)(lambda p: audit.escalated(audit.scan_activity(p), p.filter("src_ip is not null").groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("n")).filter("n >= 9").select(F.concat(F.lit("scan-activity-"), "src_ip").alias("id"), F.concat(F.lit("reached "), F.col("n").cast("string")).alias("notes"))).select("id", "escalated", "notes"))
_query(
    "fmt_duration",
    """SELECT stream_id, CASE WHEN d >= 3600 THEN printf('%dh %02dm %02ds', d // 3600, d % 3600 // 60, d % 60) WHEN d >= 60 THEN printf('%dm %02ds', d // 60, d % 60) ELSE printf('%ds', d) END AS duration FROM (SELECT stream_id, greatest(0, (last_seen_ns - first_seen_ns) // 1000000) // 1000 AS d FROM s)""",
    " ".join(streams.STREAM_COLUMNS),
)(lambda p: streams.describe_streams(streams.streams(p)).select("stream_id", scalars.duration_text(F.col("duration_ms") / 1000).alias("duration")))
_query("fmt_issue", "SELECT packet_index, CASE issue WHEN 'truncated' THEN 'Truncated' ELSE 'Checksum mismatch' END AS text FROM q WHERE issue IS NOT NULL", "capture packet_index issues")(lambda p: summaries.decode_issues(p).select("packet_index", scalars.issue_text(F.col("kind")).alias("text")))
_query("fmt_imported_endpoint", "SELECT packet_index, CASE WHEN up THEN src_ip WHEN kind = 'v6' THEN concat('[', src_ip, ']:', src_port) ELSE concat(src_ip, ':', src_port) END AS endpoint FROM q WHERE ip", "packet_index src_ip src_port")(
    lambda p: p.filter("src_ip is not null").select("packet_index", scalars.with_port(F.col("src_ip"), F.when(F.col("src_port") < 49152, F.col("src_port")), bare_brackets=False).alias("endpoint"))
)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived frames written as pcap files into the shared folder, read back and dissected."""
    import os
    import uuid
    from urllib.parse import urlparse

    folder = f"{urlparse(shared_dir(spark)).path}/pcap-{uuid.uuid4().hex}"
    os.makedirs(folder)
    write_pcaps(frames_from_events(events(spark, sf_dir)), folder)
    p = dissect(streams.with_packet_index(read_capture(spark, f"{folder}/*.pcap")), ["ts_ns", "protocol", "cap_len", "orig_len"])
    return p.groupBy("protocol", "cap_len", "orig_len").agg(F.count(F.lit(1)).alias("packets"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


QUERIES["pcap_round_trip"] = _round_trip
ORACLE_SQL["pcap_round_trip"] = PACKETS + "SELECT protocol, cap_len, orig_len, count(*) AS packets, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM q GROUP BY ALL"


def _decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second capture with some frames cut inside their Ethernet header."""
    frames = odd_frames_from_events(events(spark, sf_dir))
    cut = frames.withColumn("data", F.when(F.col("frame_no") % 16 == 15, F.substring("data", 1, 10)).otherwise(F.col("data")))
    return dissect(cut, ["frame_no", "decode_error", "protocol", "layer_names"]).select("frame_no", "decode_error", "protocol", F.size("layer_names").alias("layers"))


QUERIES["decode_errors"] = _decode_errors
ORACLE_SQL["decode_errors"] = ODD + """SELECT packet_index AS frame_no, CASE WHEN part = 15 THEN 'truncated Ethernet header' END AS decode_error,
    CASE WHEN part <= 2 THEN 'ICMP' WHEN part = 3 THEN 'UDP' WHEN part = 4 THEN 'IPv4' WHEN part = 5 THEN 'TCP' WHEN part = 6 THEN 'IPv6' WHEN part = 7 THEN 'DNS' WHEN part < 15 THEN 'Unknown' END AS protocol,
    CASE WHEN part <= 3 OR part = 5 THEN 3 WHEN part IN (4, 6) THEN 2 WHEN part = 7 THEN 4 WHEN part < 15 THEN 1 ELSE 0 END AS layers FROM o"""

# reassemble() counts on past 2 ** 32; these are the numbers in the frames.
_query("reassembled_segments", "SELECT seq, n, src_port < dst_port AS answer FROM q WHERE ip AND proto = 6 AND n > 0", "capture packet_index src_ip tcp stream_key payload_at payload_len data")(
    lambda p: reassemble(p.filter("payload_len > 0").withColumn("payload", F.expr("substring(data, payload_at + 1, payload_len)")).drop("data")).select(F.pmod("seq", F.lit(1 << 32)).alias("seq"), F.octet_length("data").alias("n"), (F.when(F.col("direction") == "lo_to_hi", streams.key_end("lo")[1]).otherwise(streams.key_end("hi")[1]) < 49152).alias("answer"))
)


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived packets written as an exporter's table into the shared folder and read back."""
    import uuid

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    p = packets(spark, sf_dir, "packet_index ts_ns cap_len orig_len protocol src_ip dst_ip src_port dst_port ipv4 ipv6 tcp udp")
    only = lambda layer, c: F.coalesce(F.when(F.col(layer).isNotNull(), F.col(c).cast("string")), F.lit(""))
    epoch = F.concat(F.expr("ts_ns div 1000000000").cast("string"), F.lit("."), F.lpad((F.col("ts_ns") % 1_000_000_000).cast("string"), 9, "0"))
    line = [(F.col("packet_index") + 1).cast("string"), epoch, F.col("orig_len").cast("string"), F.col("cap_len").cast("string"), F.col("protocol"), F.lit("info"), only("ipv4", "src_ip"), only("ipv4", "dst_ip"), only("ipv6", "src_ip"), only("ipv6", "dst_ip"), only("tcp", "src_port"), only("tcp", "dst_port"), only("udp", "src_port"), only("udp", "dst_port")]
    p.select(F.concat_ws("\t", *line)).write.text(path)
    return read_packet_table(spark, path)


QUERIES["imported_table"] = _imported
ORACLE_SQL["imported_table"] = PACKETS + "SELECT packet_index, ts_ns, cap_len, orig_len, protocol, 'info' AS info, CASE WHEN ip THEN source ELSE '' END AS source, CASE WHEN ip THEN destination ELSE '' END AS destination FROM q"
