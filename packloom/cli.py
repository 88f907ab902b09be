"""Command line: python -m packloom.cli COMMAND CAPTURE [options]. With --json, a JSON object a line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import NAMES, duration_text, hex_text, issue_text, utc_text
from .operators import audit, streams, summaries
from .operators.dissect import LAYER_NAMES, dissect
from .operators.http_messages import http_messages
from .operators.layer_views import layer_views as objects_of
from .operators.summaries import check_limit
from .plans.display_filter import display_filter, filter_columns, unknown_fields
from .plans.scan import scan_filter
from .sources.pcap import read_capture, scan_capture
from .sources.tables import read_certificates, reassemble

#: Frames that `audit` and `diff` take at most, unless told otherwise.
MOST_FRAMES = 100_000
# Colours of protocols in a terminal.
COLOURS = {"TCP": 32, "UDP": 34, "ARP": 33, "ICMP": 36, "DNS": 35, "TLS": 95, "HTTP": 92, "Ethernet": 90, "IPv4": 94, "IPv6": 96}


#: Columns of packets that most commands read.
SHOWN = {"capture", "frame_no", "packet_index", "ts_ns", "protocol", "source", "destination", "cap_len"}


def _packets(spark: SparkSession, path: str, columns: set[str], most: int | None = None, text: str | None = None) -> DataFrame:
    """Packets of the captures, whose numbers count all frames. Frames that are damaged or have no whole Ethernet header are left
    out, each with a warning. With a limit of `most` frames, more of them are an error, and so is a damaged one. With the text of
    a display filter, only packets that may pass it leave the scan."""
    if most is not None:
        return dissect(streams.with_packet_index(check_limit(read_capture(spark, path), most)), columns)
    condition, header = scan_filter(text) if text else (F.lit(True), [])
    records = scan_capture(spark, path, "PERMISSIVE", header=header)
    for r in records.filter("packet_index is null").select("frame_no", F.coalesce("error", F.lit("truncated Ethernet header")).alias("error")).orderBy("capture", "frame_no").toLocalIterator():
        print(f"warning: packet {r.frame_no + 1}: {r.error}", file=sys.stderr)
    return dissect(streams.with_packet_index(records.filter(condition & F.col("error").isNull()).drop("error", *header)), columns)


def _tracked(packets: DataFrame) -> DataFrame:
    """The packets, decoded once, with stream_id."""
    return streams.with_stream_id(streams.narrow(packets, packets.columns))


def _filtered(packets: DataFrame, text: str | None) -> DataFrame:
    if not text:
        return packets
    for name in unknown_fields(text):
        print(f"warning: unknown field {name}", file=sys.stderr)
    return packets.filter(display_filter(text))


def hex_dump(data: bytes, spans: list[tuple[int, int, str]] = (), colour: bool = False) -> str:
    """16 bytes a line in two groups, with their ASCII; the innermost span colours a byte."""
    out = []
    for at in range(0, len(data), 16):
        cells = []
        for i in range(at, min(at + 16, len(data))):
            name = next((s[2] for s in reversed(spans) if s[0] <= i < s[0] + s[1]), None)
            cell = f"{data[i]:02x}"
            cells.append(f"\x1b[{COLOURS.get(name, 2)}m{cell}\x1b[0m" if colour else cell)
        cells += ["  "] * (16 - len(cells))
        text = "".join(chr(b) if 32 <= b < 127 else "." for b in data[at : at + 16])
        out.append(f"{at:04x}  {' '.join(cells[:8])}  {' '.join(cells[8:])}  {text}")
    return "\n".join(out)


def layer_tree(row: dict) -> str:
    """The layers of one packet with their fields, indented; numbers that have names are shown with them."""
    out = []
    for layer, fields in layer_views(row):
        out.append(layer)
        for k, v in fields.items():
            if v is None or v == [] or (k == "rcode" and not (fields.get("is_response") and v)):
                continue  # a response code says something only where a response failed
            out.append(f"  {k}: {', '.join(map(str, v)) if isinstance(v, list) else v}")
    return "\n".join(out)


def layer_views(row: dict):
    """(name, fields) of each layer of a packet. Structs are flattened, and numbers that have names get them."""

    def flat(value: dict, under: str = "") -> dict:
        out = {}
        for k, v in value.items():
            key = f"{under}{k}"
            if isinstance(v, dict):
                out |= flat(v, f"{key}.")
            else:
                out[key] = v.hex() if isinstance(v, (bytes, bytearray)) else v
        return out

    named = {("eth", "ether_type"): "ether_type", ("ipv4", "protocol"): "ip_protocol", ("ipv6", "next_header"): "ip_protocol", ("arp", "operation"): "arp_operation", ("icmp", "type"): "icmp_type", ("dns", "query_type"): "dns_qtype", ("dns", "rcode"): "dns_rcode", ("tls_server_hello", "cipher_suite"): "cipher_suite", ("tls_server_hello", "selected_version"): "tls_version", ("tls_server_hello", "server_version"): "tls_version", ("tls_client_hello", "client_version"): "tls_version", ("tls_server_hello", "key_share_group"): "named_group"}
    lists = {"cipher_suites": "cipher_suite", "supported_versions": "tls_version", "signature_algorithms": "signature_algorithm", "key_share_groups": "named_group"}
    for layer, title in LAYER_NAMES.items():
        if row.get(layer) is None:
            continue
        fields = {}
        for k, v in flat(row[layer]).items():
            if k in lists:
                fields[k] = [f"{NAMES[lists[k]].get(x, 'Unknown')} ({x:#06x})" for x in v]
            elif k.startswith("compression_method"):
                fields[k] = ["null" if x == 0 else "other" for x in v] if isinstance(v, list) else None if v is None else "null" if v == 0 else "other"
            elif k == "answers":
                fields[k] = [f"{a['name']} {NAMES['dns_qtype'].get(a['record_type'], 'Unknown')} {a['data']['addr'] or str(len(a['data']['raw'])) + ' bytes'} ttl {a['ttl']}" for a in v]
            elif (layer, k) in named and v is not None:
                fields[k] = v if k == "rcode" and not v else f"{NAMES[named[layer, k]].get(v, 'Unknown')} ({v})"
            else:
                fields[k] = v
        yield title, fields


def _show(rows: DataFrame, as_json: bool, line, drop: tuple[str, ...] = ()) -> None:
    """A line of text or a JSON object for each row; of the columns in `drop` nulls are left out of objects."""
    for row in rows.toLocalIterator():
        d = row.asDict(recursive=True)
        print(json.dumps({k: v for k, v in d.items() if v is not None or k not in drop}, default=str) if as_json else line(d))


def _stats(packets: DataFrame, as_json: bool) -> None:
    """All figures come from a few small aggregates."""
    packets = streams.narrow(packets, packets.columns)
    stats = summaries.capture_stats(packets).withColumns({"first": utc_text(F.col("first_ns")), "last": utc_text(F.col("last_ns")), "duration": duration_text(F.col("duration_s"))})
    protocols = summaries.protocol_percent(packets).orderBy(F.desc("packets"), "protocol")
    if not as_json:
        _show(stats, False, lambda d: "\n".join(f"{k}: {v}" for k, v in d.items()))
        _show(protocols, False, lambda d: f"{d['protocol']:<10} {d['packets']:>8} {d['percent']:6.1f}%")
        _show(summaries.top_endpoints(packets), False, lambda d: f"{d['endpoint']:<30} {d['packets']:>8}")
        return
    d = stats.first()
    print(json.dumps({
        "packet_count": d.packet_count, "stream_count": d.stream_count, "duration_seconds": d.duration_s, "first_timestamp": d["first"], "last_timestamp": d["last"],
        "protocols": [{"name": r.protocol, "count": r.packets, "percent": float(r.percent)} for r in protocols.collect()], "top_endpoints": [{"endpoint": r.endpoint, "count": r.packets} for r in summaries.top_endpoints(packets).collect()],
    }))


def _diff(a: DataFrame, b: DataFrame, paths: tuple[str, str], as_json: bool) -> None:
    a, b = (streams.narrow(p, p.columns) for p in (a, b))
    order = ["kind", "side", F.desc("packets"), F.when(F.col("kind") == "port", F.lpad("key", 5, "0")).otherwise(F.col("key"))]
    found, deltas = summaries.compare(a, b).orderBy(*order), summaries.compare_deltas(a, b)
    if not as_json:
        _show(deltas, False, lambda d: "\n".join(f"{k}: {v}" for k, v in d.items()))
        _show(found, False, lambda d: f"{d['side']} {d['kind']} {d['key']} ({d['packets']})")
        return
    d, rows = deltas.first(), found.collect()  # hosts, protocols and ports of one side: the report itself
    out = {f"file_{s}": {"path": p, "packet_count": d[f"packets_{s}"], "stream_count": d[f"streams_{s}"]} for s, p in zip("ab", paths, strict=True)}
    for kind, plural, name in (("host", "hosts", "host"), ("protocol", "protocols", "name"), ("port", "ports", "port")):
        for what, side in (("new", "only_b"), ("missing", "only_a")):
            out[f"{what}_{plural}"] = [{name: int(r.key) if kind == "port" else r.key, "count": r.packets} for r in rows if (r.kind, r.side) == (kind, side)]
    print(json.dumps(out))


def stream_header(d: dict) -> str:
    """Who talks, how much and how long; addresses stand without brackets."""
    a, b = (e.replace("[", "").replace("]", "") for e in (d["endpoint_a"], d["endpoint_b"]))
    known = d["first_seen_ns"] is not None and d["last_seen_ns"] is not None
    duration = f"{max(0, d['last_seen_ns'] - d['first_seen_ns']) / 1e9:.3f}s" if known else "-"
    return f"Stream {d['stream_id']}: {d['protocol']} {a} \u2194 {b}\n{d['packet_count']} packets, {d['byte_count']} bytes, duration {duration}\n" + "\u2500" * 38


def _followed(packets: DataFrame, args: argparse.Namespace) -> None:
    """The bytes of a TCP conversation in order, each segment with who sent it, or its HTTP messages."""
    sent = packets.filter("payload_len > 0").withColumn("payload", F.expr("substring(data, payload_at + 1, payload_len)"))
    segments = reassemble(sent.drop("data"))
    if args.http:
        found = http_messages(segments).orderBy("capture", "direction", "seq").drop("stream_key")
        _show(found, args.json, lambda d: f"{d['direction']} {d['method']} {d['uri']} ({d['body_len']} bytes)" if d["is_request"] else f"{d['direction']} {d['status_code']} {d['content_type'] or '-'} ({d['body_len']} bytes)")
        return
    found = segments.orderBy("capture", "direction", "seq").select("capture", "direction", "seq", "data")
    _show(found.withColumn("data", hex_text(F.col("data"))) if args.json else found, args.json, lambda d: f"{d['direction']} at {d['seq']}\n{hex_dump(bytes(d['data']))}")


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "certificates":
        _show(read_certificates(spark, args.capture), args.json, lambda d: f"{d['packet_index']}  {d['common_name']}  {', '.join(d['alternative_names'])}", ("common_name", "organization"))
        return
    time = utc_text(F.col("ts_ns"))
    shown = [(F.col("frame_no") + 1).alias("number"), F.coalesce(time, F.lit("-")).alias("time"), "protocol", "source", "destination", "cap_len"]
    objects = [(F.col("frame_no") + 1).alias("index"), time.alias("timestamp"), "protocol", "source", "destination", F.col("cap_len").alias("length"), "stream_id"]
    line = lambda d: f"{d['number']:>4}  {d['time']:<24}  {d['protocol']:<5}  {d['source']:<22} -> {d['destination']:<22} {d['cap_len']:>4}"
    if args.command in ("summary", "search"):
        reads = SHOWN | (filter_columns(args.filter) - {"stream_id"} if args.filter else set()) | (set(summaries.SEARCHED) if args.command == "search" else set())
        tracked = args.json or ".stream" in (args.filter or "")  # streams are numbered over all packets
        found = _packets(spark, args.capture, reads | set(streams.STREAM_COLUMNS), text=None if tracked else args.filter)
        if tracked:
            found = _tracked(found)
        found = _filtered(found, args.filter)
        if args.command == "search":
            found = summaries.search(found, args.protocol, args.source, args.destination, args.port, True if args.has_issues else None, args.text)
        _show(found.orderBy("capture", "frame_no").select(*(objects if args.json else shown)), args.json, line)
    elif args.command == "detail":
        frame = read_capture(spark, args.capture, mode="PERMISSIVE").filter(F.col("frame_no") == args.packet - 1)
        row = dissect(frame).first()
        if row is None or row.decode_error is not None:
            raise SystemExit(f"no packet {args.packet}")
        if args.json:
            packet = dissect(frame)
            views = packet.select(F.transform(objects_of(packet), lambda v: F.to_json(v)).alias("views")).first().views
            print(f"[{','.join(views)}]")
            return
        spans = [(s.offset, s.len, n) for s, n in zip(row.spans, row.layer_names, strict=True)]
        print(layer_tree(row.asDict(recursive=True)))
        print(hex_dump(bytes(frame.first().data), spans, sys.stdout.isatty()))
    elif args.command == "stats":
        _stats(_packets(spark, args.capture, {"capture", "ts_ns", "stream_key", "protocol", "source", "destination"}), args.json)
    elif args.command == "issues":
        packets = _packets(spark, args.capture, {"capture", "frame_no", "issues"})
        rows = summaries.decode_issues(packets.withColumn("packet_index", F.col("frame_no") + 1)).orderBy("capture", "packet_index", "place").withColumn("text", issue_text(F.col("kind")))
        _show(rows.select("packet_index", "kind", "offset") if args.json else rows, args.json, lambda d: f"packet {d['packet_index']}: {d['text']} at offset {d['offset']}")
    elif args.command == "audit":
        found = audit.audit(_packets(spark, args.capture, set(audit.COLUMNS), args.max_packets), args.profile).orderBy("capture", "step", "sort_key")
        objects = found.select("id", "severity", "category", "title", F.size("packet_indexes").alias("evidence_count"), "escalated", "notes")
        _show(objects if args.json else found, args.json, lambda d: f"[{d['severity']}] {d['title']}\n    {d['summary']}", ("notes",))
    elif args.command == "follow":
        packets = _packets(spark, args.capture, SHOWN | set(streams.STREAM_COLUMNS) | ({"src_ip", "payload_at", "payload_len", "data"} if args.payload or args.http else set()))
        packets = streams.narrow(packets, packets.columns)
        rows = streams.stream_packets(packets, args.stream)
        if args.payload or args.http:
            _followed(rows, args)
            return
        if not args.json:
            _show(streams.describe_streams(streams.streams(packets)).filter(F.col("stream_id") == args.stream), False, stream_header)
        _show(rows.select(*(objects if args.json else shown)), args.json, line)
    elif args.command == "diff":
        _diff(*(_packets(spark, p, set(summaries.COMPARED), args.max_packets) for p in (args.capture, args.other)), (args.capture, args.other), args.json)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="packloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("summary", "detail", "stats", "issues", "audit", "follow", "search", "certificates", "diff"):
        p = sub.add_parser(name)
        p.add_argument("capture")
        p.add_argument("--json", action="store_true")
        if name in ("summary", "search"):
            p.add_argument("-f", "--filter")
        if name == "search":
            for option in ("--protocol", "--source", "--destination", "--text"):
                p.add_argument(option)
            p.add_argument("--port", type=int)
            p.add_argument("--has-issues", action="store_true")
        if name == "detail":
            p.add_argument("packet", type=int)
        if name == "follow":
            p.add_argument("stream", type=int)
            p.add_argument("--payload", action="store_true", help="the reassembled bytes")
            p.add_argument("--http", action="store_true", help="the HTTP messages")
        if name == "audit":
            p.add_argument("--profile", choices=list(audit.PROFILES))
        if name == "diff":
            p.add_argument("other")
        if name in ("audit", "diff"):
            p.add_argument("--max-packets", type=int, default=MOST_FRAMES, help="more frames are an error")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(args, SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())


if __name__ == "__main__":
    main()
