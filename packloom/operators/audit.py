"""Audit heuristics: each finds packets by a rule and reports them as findings.

A finding belongs to one capture and has an id, severity, category, title, summary, a description of
its evidence and the indexes of its first packets (100 at most, which is part of the report);
several captures are audited each on its own. Evidence comes
from a rank within each group, which Spark limits before it shuffles, so that a group with
a third of all packets costs no task more than its limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Stored
from .streams import describe_streams, key_protocol, narrow, streams, with_stream_id

EVIDENCE = 100
# Thresholds and port lists of the rules, and the texts of findings below.
RATIO, FAN_OUT, NAMES_MOST, LABEL_MOST, TXT_MOST, NXDOMAIN_LEAST, RST_LEAST, HALF_OPEN_LEAST = 0.5, 5, 50, 50, 10, 20, 3, 10
SUSPICIOUS_PORTS = [23, 445, 2323, 3389, 5900]
#: Columns of packets that the rules read.
COLUMNS = ["capture", "packet_index", "ts_ns", "cap_len", "protocol", "src_ip", "dst_ip", "dst_port", "issues", "stream_key", "tcp", "dns"]
CLEARTEXT = {21: "FTP", 23: "Telnet", 80: "HTTP", 110: "POP3", 143: "IMAP"}


def _first(rows: DataFrame, keys: list[str], n: int = EVIDENCE, order: list | None = None) -> DataFrame:
    """keys and evidence: the first n packet indexes of each group."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or ["packet_index"])))).filter(f"_rank <= {n}")
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "packet_index"))), lambda x: x["packet_index"]).alias("packet_indexes"))


def _finding(rows: DataFrame, step: int, key: Column, id_: Column, severity: str | Column, category: str, title: Column, summary: Column, description: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(
        "capture", F.lit(step).alias("step"), key.cast("string").alias("sort_key"), id_.alias("id"), severity.alias("severity"), F.lit(category).alias("category"), title.alias("title"), summary.alias("summary"),
        "packet_indexes", description.alias("description"), F.lit(False).alias("escalated"), F.lit(None).cast("string").alias("notes"),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _ratio(packets: DataFrame, affected: Column, step: int, id_: str, severity: str, category: str, title: str, summary: str) -> DataFrame:
    counts = packets.groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.count_if(affected).alias("hit")).filter(f"hit / n >= {RATIO}")
    rows = counts.join(_first(packets.filter(affected).select("capture", "packet_index"), ["capture"]), "capture")
    percent = F.bround(F.col("hit") / F.col("n") * 100, 0).cast("long")
    return _finding(rows, step, F.lit(""), F.lit(id_), severity, category, F.lit(title), F.lit(summary), _text(f"{category} affected ", percent, "% of packets in the capture."))


def decode_issue_ratio(packets: DataFrame) -> DataFrame:
    return _ratio(packets, F.size("issues") > 0, 1, "decode-issues", "high", "decode_issues", "Decode issues affect a large share of packets", "Packets contain malformed or truncated decode results that may indicate capture corruption or evasive traffic.")


def unknown_ratio(packets: DataFrame) -> DataFrame:
    return _ratio(packets, F.lower("protocol") == "unknown", 2, "unknown-traffic", "medium", "unknown_traffic", "Unknown traffic dominates the capture", "A large portion of packets could not be classified beyond the link layer, which reduces audit confidence.")


def scan_activity(packets: DataFrame) -> DataFrame:
    """Sources that reach many destinations; evidence has each destination's first packet first."""
    sent = packets.filter("src_ip is not null").select("capture", "src_ip", "dst_ip", "packet_index")
    pairs = sent.groupBy("capture", "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    wide = pairs.groupBy("capture", "src_ip").agg(F.count(F.lit(1)).alias("targets")).filter(f"targets >= {FAN_OUT}")
    each = sent.join(wide.select("capture", "src_ip"), ["capture", "src_ip"], "left_semi")
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("capture", "src_ip", "dst_ip").orderBy("packet_index"))).filter(f"_n <= {EVIDENCE}")
    evidence = _first(each, ["capture", "src_ip"], order=[F.col("_n") > 1, "dst_ip", "packet_index"])
    s, n = F.col("src_ip"), F.col("targets")
    return _finding(wide.join(evidence, ["capture", "src_ip"]), 3, s, _text("scan-activity-", s), "high", "scan_activity", _text("Endpoint fan-out from ", s, " looks scan-like"), _text(s, " contacted ", n, " distinct destinations in a single capture."), _text("Observed fan-out to ", n, " unique destination hosts."))


def suspicious_ports(packets: DataFrame) -> DataFrame:
    p = F.col("dst_port")
    rows = _first(packets.filter(p.isin(SUSPICIOUS_PORTS)).select("capture", "dst_port", "packet_index"), ["capture", "dst_port"])
    return _finding(rows, 4, F.lpad(p.cast("string"), 5, "0"), _text("suspicious-port-", p), "medium", "suspicious_ports", _text("Traffic observed on suspicious destination port ", p), _text("The capture includes packets targeting destination port ", p, ", which commonly appears in audit findings."), _text("Packets targeted destination port ", p, "."))


def cleartext(packets: DataFrame) -> DataFrame:
    p = F.col("dst_port")
    rows = _first(packets.filter(p.isin(list(CLEARTEXT))).select("capture", "dst_port", "packet_index"), ["capture", "dst_port"])
    name = F.element_at(F.create_map(*[F.lit(x) for kv in CLEARTEXT.items() for x in kv]), p)
    rows = rows.withColumn("name", name)
    n = F.col("name")
    summary = _text(n, " transmits data without encryption. Credentials, session tokens, and other sensitive information sent over port ", p, " can be intercepted by anyone with network access.")
    return _finding(rows, 5, F.lpad(p.cast("string"), 5, "0"), _text("cleartext-", F.lower(n)), "high", "cleartext_credentials", _text(n, " traffic on port ", p, " may expose credentials in cleartext"), summary, _text("Packets targeted ", n, " destination port ", p, "."))


def connection_anomalies(packets: DataFrame) -> DataFrame:
    """Odd TCP conversations. Packets are read more than once: give narrow() ones."""
    table = Stored(packets.sparkSession, "streams").put(streams(packets))
    flags = F.col("tcp_flags_seen")
    rules = [
        ("handshake", (flags.bitwiseAND(2) != 0) & ~F.col("syn_ack_seen")),
        ("rst", F.col("rst_count") >= RST_LEAST),
        ("open", (flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(16) != 0) & (flags.bitwiseAND(5) == 0) & (F.col("packet_count") >= HALF_OPEN_LEAST)),
    ]
    tcp = describe_streams(table.filter(key_protocol() == 6))
    plain = lambda c: F.regexp_replace(c, r"^\[(.*)\]:", "$1:")
    odd = tcp.filter(rules[0][1] | rules[1][1] | rules[2][1])
    sent = with_stream_id(packets.select("capture", "packet_index", "stream_key"), table).filter("stream_id is not null").select("capture", "stream_id", "packet_index")
    evidence = _first(sent.join(odd.select("capture", "stream_id"), ["capture", "stream_id"], "left_semi"), ["capture", "stream_id"])
    rows = odd.join(evidence, ["capture", "stream_id"])
    i = F.col("stream_id")
    ends = [plain("endpoint_a"), " ↔ ", plain("endpoint_b")]
    rst, packets_ = F.col("rst_count"), F.col("packet_count")
    words = {
        "handshake": ("incomplete-handshake-", "medium", _text("Incomplete TCP handshake on stream ", i, " (", *ends, ")"), _text("Stream ", i, " contains a SYN but no SYN+ACK was observed, indicating an incomplete TCP handshake."), _text("Packets from stream ", i, " with incomplete handshake.")),
        "rst": ("rst-storm-", "medium", _text("RST storm on stream ", i, " (", rst, " RST packets)"), _text("Stream ", i, " contains ", rst, " RST packets, which may indicate a connection teardown storm or port scanning."), _text("Packets from stream ", i, " exhibiting RST storm behavior.")),
        "open": ("half-open-", "low", _text("Half-open connection on stream ", i, " (", packets_, " packets, no FIN/RST)"), _text("Stream ", i, " exchanged ", packets_, " packets after the handshake but was never closed with FIN or RST."), _text("Packets from stream ", i, " with no connection teardown.")),
    }
    # A conversation can break several rules: one pass over the odd ones, a finding for each rule.
    found = []
    for k, (name, test) in enumerate(rules):
        id_, severity, title, summary, description = words[name]
        key = F.concat(F.lpad(i.cast("string"), 12, "0"), F.lit(f"-{k}"))
        found.append(F.when(test, F.struct(key.alias("key"), _text(id_, i).alias("id"), F.lit(severity).alias("severity"), title.alias("title"), summary.alias("summary"), description.alias("description"))))
    rows = rows.select("capture", "packet_indexes", F.explode(F.array_compact(F.array(*found))).alias("f")).select("capture", "packet_indexes", "f.*")
    return _finding(rows, 6, F.col("key"), F.col("id"), F.col("severity"), "connection_anomaly", F.col("title"), F.col("summary"), F.col("description"))


def dns_tunneling(packets: DataFrame) -> DataFrame:
    """Sources with many query names, long labels (in bytes, as the text's "characters") or many
    TXT queries."""
    dns = packets.filter("dns is not null and src_ip is not null")
    long = F.exists(F.split("dns.query_name", r"\."), lambda x: F.octet_length(x) > LABEL_MOST)
    counts = dns.groupBy("capture", "src_ip").agg(F.count_distinct("dns.query_name").alias("names"), F.count_if(long).alias("long"), F.count_if(F.col("dns.query_type") == 16).alias("txt"))
    counts = counts.filter(f"names > {NAMES_MOST} or long > 0 or txt > {TXT_MOST}")
    evidence = _first(dns.select("capture", "src_ip", "packet_index").join(counts.select("capture", "src_ip"), ["capture", "src_ip"], "left_semi"), ["capture", "src_ip"])
    s = F.col("src_ip")
    parts = F.concat_ws("; ", F.when(F.col("names") > NAMES_MOST, _text(F.col("names"), f" unique query names (threshold: {NAMES_MOST})")), F.when(F.col("long") > 0, _text(F.col("long"), f" queries with labels longer than {LABEL_MOST} characters")), F.when(F.col("txt") > TXT_MOST, _text(F.col("txt"), f" TXT queries (threshold: {TXT_MOST})")))
    return _finding(counts.join(evidence, ["capture", "src_ip"]), 7, s, _text("dns-tunneling-", s), "high", "dns_tunneling", _text("Possible DNS tunneling activity from ", s), _text("DNS traffic from ", s, " exhibits indicators of tunneling: ", parts, "."), _text("DNS queries from ", s, " with tunneling indicators."))


def nxdomain_storm(packets: DataFrame) -> DataFrame:
    """Many NXDOMAIN responses. The reported count goes no higher than the evidence's limit."""
    hit = packets.filter("dns.is_response and dns.rcode = 3").select("capture", "packet_index")
    rows = _first(hit, ["capture"]).withColumn("n", F.size("packet_indexes")).filter(f"n >= {NXDOMAIN_LEAST}")
    n = F.col("n")
    summary = _text("The capture contains ", n, " DNS responses with RCODE NXDOMAIN, which may indicate domain generation algorithm (DGA) activity, malware beaconing to non-existent domains, or DNS enumeration.")
    return _finding(rows, 8, F.lit(""), F.lit("nxdomain-storm"), "high", "dns_anomaly", _text("High NXDOMAIN rate: ", n, " responses with RCODE 3 (possible DGA/malware)"), summary, _text(n, " NXDOMAIN responses observed."))


PROFILES: dict[str, list[Callable[[DataFrame], DataFrame]]] = {
    "quality": [decode_issue_ratio, unknown_ratio],
    "security": [scan_activity, suspicious_ports, cleartext, connection_anomalies],
    "dns": [dns_tunneling, nxdomain_storm],
}


def audit(packets: DataFrame, profile: str | None = None) -> DataFrame:
    """All findings of a profile, or of all; order by step and sort_key for the report's order."""
    if profile is not None and profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; valid: {', '.join(PROFILES)}")
    rules = [r for name, rs in PROFILES.items() if profile in (None, name) for r in rs]
    packets = narrow(packets, COLUMNS)
    out = rules[0](packets)
    for rule in rules[1:]:
        out = out.unionByName(rule(packets))
    return out


def escalated(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings with the notes on them: notes has a row (id, notes) for each finding that was escalated."""
    kept = [c for c in findings.columns if c not in ("notes", "escalated")]
    return findings.select(*kept).join(notes.select("id", "notes"), "id", "left").select(*kept, F.col("notes").isNotNull().alias("escalated"), "notes")


def severity_tally(findings: DataFrame) -> DataFrame:
    """Findings per severity; what is neither high nor medium counts as low."""
    high, medium = F.col("severity") == "high", F.col("severity") == "medium"
    return findings.agg(F.count_if(high).alias("high"), F.count_if(medium).alias("medium"), F.count_if(~high & ~medium).alias("low"))


def listed(findings: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """Findings of a severity and a category, whatever the case of their letters."""
    for name, value in (("severity", severity), ("category", category)):
        if value is not None:
            findings = findings.filter(F.lower(name) == value.lower())
    return findings


def explained(findings: DataFrame, finding_id: str) -> DataFrame:
    """The finding of an id, without notes on it."""
    return findings.filter(F.col("id") == finding_id)
