import json
import struct

import duckdb
import pytest

from packloom import queries
from packloom.cli import hex_dump, main
from packloom.operators import audit, streams, summaries
from packloom.operators.dissect import dissect
from packloom.plans.session import SessionError, Sessions
from packloom.sources import pcap, tables
from wire import frames, ipv4, tcp, udp

SF = "/root/testdata/sf0.001"


def indexed(spark, *data):
    return dissect(streams.with_packet_index(frames(spark, *data)))


@pytest.mark.parametrize("name", ["protocol_counts", "decode_tcp", "filter_not_missing", "stream_metadata", "audit_scan", "compare_ports", "top_endpoints"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_indexes_skip_undecodable_frames(spark):
    p = indexed(spark, ipv4(6, tcp(1, 2)), b"short", ipv4(6, tcp(3, 4)))
    assert [tuple(r) for r in p.select("frame_no", "packet_index").orderBy("frame_no").collect()] == [(0, 0), (2, 1)]


def test_dense_index_over_stretches(spark):
    df = spark.range(1000).selectExpr("'a' as capture", "id * 7 as n")
    got = streams.dense_index(df, ["capture"], "n", "i", stretch=100)
    assert got.filter("i * 7 <> n").count() == 0 and got.count() == 1000


def test_streams_join_both_directions(spark):
    a, b = (192, 0, 2, 10), (198, 51, 100, 20)
    p = indexed(spark, ipv4(6, tcp(9, 80, flags=2)), ipv4(6, tcp(80, 9, flags=18), src=b, dst=a), ipv4(17, udp(9, 80)), ipv4(6, tcp(9, 80, flags=4)))
    rows = {r.stream_id: r for r in streams.streams(p).collect()}
    assert [rows[i].packet_count for i in (0, 1)] == [3, 1] and rows[0].syn_ack_seen and rows[0].rst_count == 1 and rows[0].tcp_flags_seen == 22
    assert rows[0].first_seen_ns == 1_000_000_000 and rows[0].last_seen_ns == 4_000_000_000
    with pytest.raises(ValueError, match="0..1"):
        streams.stream_packets(p, 9)


@pytest.mark.parametrize("targets, found", [(4, 0), (5, 1)])
def test_scan_threshold(spark, targets, found):
    p = indexed(spark, *(ipv4(6, tcp(1, 2), dst=(10, 0, 0, i)) for i in range(targets)), ipv4(6, tcp(1, 2), dst=(10, 0, 0, 0)))
    rows = audit.scan_activity(p).collect()
    assert len(rows) == found and all(r.packet_indexes == [0, 1, 2, 3, 4, 5] for r in rows)


def test_ratio_audits_and_profiles(spark):
    cut = ipv4(6, tcp(1, 2))[:30]
    p = indexed(spark, cut, cut, cut, ipv4(6, tcp(1, 23)))
    got = {r.id: r for r in audit.audit(p, "quality").collect()}
    assert set(got) == {"decode-issues", "unknown-traffic"} and got["decode-issues"].description == "decode_issues affected 75% of packets in the capture."
    assert [r.id for r in audit.audit(p, "security").orderBy("step", "sort_key").collect()] == ["suspicious-port-23", "cleartext-telnet", "incomplete-handshake-0"]
    with pytest.raises(ValueError):
        audit.audit(p, "nosuch")


def test_paging_is_clamped(spark):
    df = spark.range(3000)
    assert summaries.page(df, ["id"], 10, 5000).count() == 1000 and summaries.page(df, ["id"], 2990).count() == 10
    with pytest.raises(ValueError):
        summaries.check_limit(df, 100)


def test_pcap_round_trip(spark, tmp_path):
    data = [ipv4(6, tcp(1, 2, b"x" * i)) for i in range(50)]
    f = frames(spark, *data)
    pcap.write_pcaps(f.coalesce(1), str(tmp_path)).collect()
    whole = pcap.read_capture(spark, f"{tmp_path}/*.pcap", split_bytes=500)
    assert whole.rdd.getNumPartitions() > 3
    assert [(r.frame_no, r.packet_index, r.ts_ns, bytes(r.data)) for r in whole.orderBy("frame_no").collect()] == [(i, i, (i + 1) * 10**9, d) for i, d in enumerate(data)]
    spark.dataSource.register(pcap.CaptureSource)
    assert spark.read.format("capture").load(f"{tmp_path}/*.pcap").count() == 50
    pcap.write_pcaps(f.coalesce(1), str(tmp_path))
    assert [p.name[:10] for p in tmp_path.iterdir()] == ["part-00000"]
    path = next(tmp_path.glob("*.pcap"))
    assert pcap.read_small_captures(spark, str(path)).count() == 50
    path.write_bytes(path.read_bytes()[:-3])
    assert pcap.read_capture(spark, str(path), mode="PERMISSIVE").count() == 49
    with pytest.raises(Exception, match="truncated record"):
        pcap.read_capture(spark, str(path)).count()


def test_pcapng_and_errors():
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    interface = lambda link: block(1, struct.pack("<HHI", link, 0, 0))
    data = ipv4(6, tcp(1, 2)) + b"\0\0"
    packet = block(6, struct.pack("<5I", 0, 0, 2_000_000, len(data), len(data) + 5) + data)
    simple = block(3, struct.pack("<I", len(data)) + data)
    rows = pcap.parse_capture(head + interface(1) + packet + simple)
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows] == [(0, 0, 2_000_000_000, 56, 61), (1, 1, None, 56, 56)] and rows[0][6] == data
    for bad in (head + interface(1) + interface(101) + packet, head + packet, b"abc", b"\xd4\xc3\xb2\xa1" + b"\0" * 5):
        with pytest.raises(pcap.CaptureError):
            pcap.parse_capture(bad)


def test_imported_tables(spark, tmp_path):
    rows = ["\t".join(tables.COLUMNS), "1\t1.5\t60\t54\tTCP\tinfo\t1.2.3.4\t5.6.7.8\t\t\t80\t99\t\t", "", "2\t-1\t70\t70\tUDP\t\t\t\tfe80::1\tfe80::2\t\t\t53\t54", "3\tx\t70\t70\tX\t\t\t\tfe80::1\t\t\t\t\t"]
    (tmp_path / "a.tsv").write_text("\n".join(rows))
    got = [tuple(r) for r in tables.read_packet_table(spark, str(tmp_path / "a.tsv")).orderBy("packet_index").collect()]
    assert got[0] == (0, 1_500_000_000, 54, 60, "TCP", "info", "1.2.3.4:80", "5.6.7.8:99") and got[1][6:] == ("[fe80::1]:53", "[fe80::2]:54") and got[1][1] is None and got[2][6:] == ("fe80::1", "")


def test_followed_streams():
    rule, head = "=" * 20, "Follow: tcp,raw\nFilter: tcp.stream eq 0\nNode 0: 1.2.3.4:5\nNode 1: 5.6.7.8:80\n"
    for text in (f"\n{rule}\n{head}0a0b\n\t0c\n\n{rule}\n", f"{rule}\n{head}{rule}\n0a0b\n\t0c\n{rule}\n"):
        got = tables.parse_followed(text)
        assert (got.client, got.server, got.segments) == ("1.2.3.4:5", "5.6.7.8:80", [("client_to_server", b"\n\x0b"), ("server_to_client", b"\x0c")])
    got = tables.parse_followed(f"{rule}\n{head}GET /\n\n\tHTTP/1.1 200 OK\n{rule}\n", "http")
    assert [b for _, b in got.segments] == [b"GET /\n", b"\n", b"HTTP/1.1 200 OK\n"]
    for bad in ("0a0b", f"{rule}\n{head}0a0\n{rule}\n", f"{rule}\n{head}xx\n{rule}\n"):
        with pytest.raises(ValueError):
            tables.parse_followed(bad)


def test_reassembly(spark):
    a, b = (192, 0, 2, 10), (198, 51, 100, 20)
    said = lambda seq, data, **k: ipv4(6, struct.pack(">HHIIBBHHH", 80, 80, seq, 0, 5 << 4, 24, 1024, 0, 0) + data, **k)
    data = [said(2**32 - 3, b"abc"), said(0, b"def"), said(0, b"def"), said(1, b"efgh"), said(7, b"x", src=b, dst=a), said(2**32 - 3, b"abc")]
    p = indexed(spark, *data)
    got = tables.reassemble(p.join(frames(spark, *data).select("frame_no", "data"), "frame_no").selectExpr("*", "substring(data, payload_at + 1, payload_len) as payload"))
    rows = sorted((r.direction, r.seq, bytes(r.data)) for r in got.collect())
    base = 2**32
    assert rows == [("hi_to_lo", 7, b"x"), ("lo_to_hi", base - 3, b"abc"), ("lo_to_hi", base, b"def"), ("lo_to_hi", base + 3, b"gh")]


def test_several_captures_are_audited_apart(spark):
    from pyspark.sql import functions as F

    one = frames(spark, *(ipv4(6, tcp(i, 23)) for i in range(1, 4)), *(ipv4(6, tcp(1, 2), dst=(10, 0, 0, i)) for i in range(6)))
    two = frames(spark, ipv4(6, tcp(1, 23)), ipv4(6, tcp(1, 23)), b"short").withColumn("capture", F.lit("u"))
    said = lambda f: {tuple(map(str, r)) for r in audit.audit(dissect(streams.with_packet_index(f))).select("capture", "id", "packet_indexes", "summary").collect()}
    assert said(one.unionByName(two)) == said(one) | said(two)
    both = streams.stream_packets(dissect(streams.with_packet_index(one.unionByName(two))), 0)
    assert [(r.capture, r.packet_index) for r in both.collect()] == [("t", 0), ("u", 0), ("u", 1)]


def test_columns_are_pruned(spark):
    f = frames(spark, ipv4(6, tcp(1, 2)))
    assert dissect(f, ["capture", "protocol"]).columns == ["capture", "protocol"]
    with pytest.raises(ValueError, match="nosuch"):
        dissect(f, ["nosuch"])
    plan = queries.QUERIES["protocol_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # One exchange of counts, beside the one that spreads a small file's rows.
    assert plan.count("Exchange hashpartitioning(protocol") == 1 and plan.count("Exchange") == 2 and "Sort" not in plan and "Window" not in plan


def test_sessions(spark):
    now = [0.0]
    s = Sessions(spark, most=1, idle_seconds=10, clock=lambda: now[0])
    one = s.open_frames(frames(spark, ipv4(6, tcp(1, 23, b"ab")), ipv4(6, tcp(1, 23, b"cd"))))
    with pytest.raises(SessionError):
        s.open_frames(frames(spark, ipv4(6, tcp(1, 2))))
    assert s.describe_capture(one)["packet_count"] == 2 and s.list_packets(one, filter="port 23", protocol="tcp").count() == 2
    s.escalate_finding(one, "suspicious-port-23", "look")
    assert [r.notes for r in s.list_findings(one, severity="MEDIUM", category="suspicious_ports").collect()] == ["look"]
    assert [bytes(r.data) for r in s.get_stream_payload(one, 0).collect()] == [b"ab"]
    with pytest.raises(SessionError):
        s.explain_finding(one, "nosuch")
    now[0] = 11
    with pytest.raises(SessionError):
        s.describe_capture(one)


def test_command_line(spark, tmp_path, capsys):
    pcap.write_pcaps(frames(spark, ipv4(6, tcp(1, 23)), ipv4(17, udp(5, 6))).coalesce(1), str(tmp_path)).collect()
    path = str(next(tmp_path.glob("*.pcap")))
    for argv in (["summary", path, "-f", "udp"], ["detail", path, "1"], ["stats", path], ["issues", path], ["search", path, "--port", "23", "--json"], ["follow", path, "0"], ["diff", path, path]):
        main(argv)
    out = capsys.readouterr().out
    assert "192.0.2.10:5" in out and "0010  " in out and '"protocol": "TCP"' in out and "packet_delta: 0" in out
    for argv, keys in ((["diff", path, path], {"file_a", "file_b", "new_hosts", "missing_hosts", "new_protocols", "missing_protocols", "new_ports", "missing_ports"}), (["stats", path], {"packet_count", "stream_count", "duration_seconds", "first_timestamp", "last_timestamp", "protocols", "top_endpoints"}), (["summary", path, "-f", "tcp"], {"index", "timestamp", "protocol", "source", "destination", "length", "stream_id"}), (["audit", path, "--profile", "security"], {"id", "severity", "category", "title", "evidence_count", "escalated"})):
        main([*argv, "--json"])
        assert set(json.loads(capsys.readouterr().out.splitlines()[0])) == keys
    main(["detail", path, "1", "--json"])
    layers = json.loads(capsys.readouterr().out)
    assert [x["type"] for x in layers] == ["Ethernet", "IPv4", "TCP"] and layers[2]["source_port"] == 1 and layers[2]["flags"]["syn"] is True and layers[0]["ether_type"] == 2048
    for text, lines in (("udp", 1), ("tcp and port 23", 1), ("port 6 or tcp", 2), ("host 10.9.9.9", 0), ("udp.stream == 1", 1)):
        main(["summary", path, "-f", text])
        assert len(capsys.readouterr().out.splitlines()) == lines, text
    main(["follow", path, "0"])
    header = capsys.readouterr().out.splitlines()
    assert header[0] == "Stream 0: TCP 192.0.2.10:1 \u2194 198.51.100.20:23" and header[1].startswith("1 packets, 54 bytes, duration 0.000s") and header[2] == "\u2500" * 38 and len(header) == 4
    whole = next(tmp_path.glob("*.pcap"))
    (tmp_path / "cut.pcap").write_bytes(whole.read_bytes()[:-3])
    main(["issues", str(tmp_path / "cut.pcap")])
    assert "warning: packet 2: truncated record" in capsys.readouterr().err
    with pytest.raises(Exception, match="truncated record"):
        main(["audit", str(tmp_path / "cut.pcap")])
    with pytest.raises(ValueError, match="more than 1"):
        main(["audit", path, "--max-packets", "1"])
    assert hex_dump(b"AB\0").splitlines()[0].endswith("AB.")


def test_streaming_source(spark, tmp_path):
    from packloom.streaming.captures import running_streams, stream_packets

    pcap.write_pcaps(frames(spark, ipv4(6, tcp(1, 23)), ipv4(6, tcp(1, 23))).coalesce(1), str(tmp_path)).collect()
    query = running_streams(stream_packets(spark, str(tmp_path))).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.packet_count for r in spark.table("live").collect()] == [2]


def test_follow_payload_and_messages(spark, tmp_path, capsys):
    said = lambda seq, data: ipv4(6, struct.pack(">HHIIBBHHH", 9, 80, seq, 0, 5 << 4, 24, 1024, 0, 0) + data)
    text = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n"
    pcap.write_pcaps(frames(spark, said(5, text[:19]), said(24, text[19:]), said(21, text[16:25])).coalesce(1), str(tmp_path))
    path = str(next(tmp_path.glob("*.pcap")))
    main(["follow", path, "0", "--payload"])
    out = capsys.readouterr().out
    assert "lo_to_hi at 5" in out and "GET /a HTTP/1.1." in out
    main(["follow", path, "0", "--http", "--json"])
    assert [(m["uri"], m["host"], m["complete"]) for m in map(json.loads, capsys.readouterr().out.splitlines())] == [("/a", "h", True)]


def test_hex_and_json_texts(spark):
    from pyspark.sql import functions as F

    from packloom.functions.scalars import hex_bytes, hex_text, json_line

    df = spark.createDataFrame([(b"\x00\xaf", "0", None), (b"", "x\"y\n", 1)], "b binary, t string, n int")
    rows = df.select(hex_text(F.col("b")).alias("h"), hex_bytes(hex_text(F.col("b"))).alias("b"), json_line({"t": F.col("t"), "n": F.col("n"), "m": F.col("n")}, ("m",)).alias("j")).collect()
    assert [(r.h, bytes(r.b), json.loads(r.j)) for r in rows] == [("00af", b"\x00\xaf", {"t": "0", "n": None}), ("", b"", {"t": 'x"y\n', "n": 1, "m": 1})]
    with pytest.raises(Exception, match="no hex bytes"):
        spark.range(1).select(hex_bytes(F.lit("abc"))).collect()


def test_filter_tables_equal_single_filters(spark):
    from packloom.plans.display_filter import display_filter
    from packloom.plans.filter_table import filters_of, matching

    f = frames(spark, *(ipv4(6, tcp(i % 5, 80 + i % 3)) for i in range(30)), *(ipv4(17, udp(i, 53)) for i in range(9)))
    filters = {f"f{i}": f"(tcp.port == {i % 7} or not port {80 + i % 4}) and frame.len > {50 + i % 9} or not udp" for i in range(100)}
    table = spark.createDataFrame(list(filters.items()), "id string, text string")
    assert filters_of(table) == filters
    rows = matching(f, filters, ["frame_no"]).collect()
    p = dissect(f)
    for i in ("f0", "f17", "f99"):
        assert sorted(r.frame_no for r in rows if i in r.matches) == sorted(r.frame_no for r in p.filter(display_filter(filters[i])).collect())
    with pytest.raises(ValueError, match="equal ids"):
        filters_of(table.unionByName(table))
