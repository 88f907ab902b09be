import random
import struct

from packloom.operators.dissect import dissect
from wire import eth, frames, ipv4, ipv6, ones, tcp, udp


def packets(spark, *data):
    return [r.asDict(recursive=True) for r in dissect(frames(spark, *data)).orderBy("frame_no").collect()]


def issues(p):
    return [(i["kind"], i["offset"]) for i in p["issues"]]


def test_tcp_and_spans(spark):
    (p,) = packets(spark, ipv4(6, tcp(51514, 443)))
    assert p["protocol"] == "TCP" and p["source"] == "192.0.2.10:51514" and p["destination"] == "198.51.100.20:443"
    assert [(s["offset"], s["len"]) for s in p["spans"]] == [(0, 14), (14, 20), (34, 20)]
    assert p["tcp"]["flags"]["syn"] and not p["tcp"]["flags"]["ack"] and p["tcp"]["window"] == 1024 and p["issues"] == []


def test_network_failures(spark):
    short, bad_version, bad_ihl, bad_total, long_total, padded = packets(
        spark, ipv4(6, tcp(1, 2))[:30], eth(0x0800, b"\x65" + b"\0" * 30), ipv4(6, tcp(1, 2), ihl=5)[:14] + b"\x44" + b"\0" * 40,
        ipv4(6, tcp(1, 2), total=10), ipv4(17, udp(5, 6), total=60), ipv4(17, udp(5, 6, b"ab")) + b"\0" * 9,
    )
    assert issues(short) == [("truncated", 30)] and short["protocol"] == "Unknown"
    assert issues(bad_version) == issues(bad_ihl) == issues(bad_total) == [("malformed", 14)]
    assert issues(long_total) == [("truncated", 42)] and long_total["udp"] is not None
    assert issues(padded) == [] and padded["payload_len"] == 2


def test_transport_failures(spark):
    cut, offset, small, options, odd_udp = packets(spark, ipv4(6, tcp(1, 2)[:12]), ipv4(6, tcp(1, 2, offset=5)[:12] + b"\x40" + b"\0" * 7), ipv4(17, udp(1, 2, length=7)), ipv4(6, tcp(1, 2, offset=8)), ipv4(17, udp(1, 2, length=99)))
    assert issues(cut) == [("truncated", 46)] and issues(offset) == [("malformed", 34)] and issues(small) == [("malformed", 34)]
    assert options["spans"][2] == {"offset": 34, "len": 32} and issues(odd_udp) == []


def test_checksums(spark):
    body = udp(1, 2, b"abc")
    pseudo = bytes((192, 0, 2, 10, 198, 51, 100, 20, 0, 17)) + struct.pack(">H", len(body))
    good = udp(1, 2, b"abc", checksum=ones(pseudo + body))
    ok, bad, head_ok, six_zero, fragment = packets(spark, ipv4(17, good), ipv4(17, udp(1, 2, b"abc", checksum=7)), ipv4(17, body, checksum=True), ipv6(17, body), ipv4(17, udp(1, 2, b"abc", checksum=7), frag=0x2000))
    assert issues(ok) == issues(head_ok) == issues(fragment) == []
    assert issues(bad) == [("checksum_mismatch", 34)] and issues(six_zero) == [("checksum_mismatch", 54)]


def test_ipv6_extensions(spark):
    hop = bytes((6, 0)) + b"\0" * 6
    atomic, later = bytes((6, 0, 0, 0)) + b"\0" * 4, bytes((6, 0, 0, 8)) + b"\0" * 4
    a, b, c, esp = packets(spark, ipv6(0, hop + tcp(1, 2)), ipv6(44, atomic + tcp(1, 2)), ipv6(44, later + tcp(1, 2)), ipv6(50, tcp(1, 2)))
    assert a["tcp"] is not None and a["ipv6"]["next_header"] == 0 and a["spans"][1] == {"offset": 14, "len": 48} and a["stream_key"][-1] == 0
    assert b["tcp"] is not None and c["tcp"] is None and esp["tcp"] is None
    assert a["source"] == "[2001:db8::1]:1" and esp["source"] == "[2001:db8::1]"


def test_icmp_arp_and_unknown(spark):
    arp = struct.pack(">HHBBH", 1, 0x0800, 6, 4, 2) + b"\1" * 6 + bytes((10, 0, 0, 1)) + b"\2" * 6 + bytes((10, 0, 0, 2))
    echo, brief, reply, short, other = packets(spark, ipv4(1, struct.pack(">BBHHH", 8, 0, 0, 7, 9)), ipv4(1, b"\x03\x01\0\0"), eth(0x0806, arp), eth(0x0806, arp[:20]), eth(0x8100, b"\0" * 50))
    assert echo["icmp"]["detail"] == {"kind": "EchoRequest", "identifier": 7, "sequence": 9, "next_hop_mtu": None, "rest_of_header": None}
    assert brief["icmp"]["detail"] is None and brief["spans"][2]["len"] == 4
    assert reply["source"] == "10.0.0.1" and reply["destination"] == "10.0.0.2" and reply["protocol"] == "ARP"
    assert issues(short) == [("truncated", 34)] and other["protocol"] == "Unknown" and other["source"] == ""


def test_dns(spark):
    name = b"\x06google\x03com\0"
    query = struct.pack(">6H", 0x1234, 0x0100, 1, 0, 0, 0) + name + struct.pack(">2H", 1, 1)
    answer = struct.pack(">6H", 1, 0x8183, 1, 1, 0, 0) + name + struct.pack(">2H", 28, 1) + b"\xc0\x0c" + struct.pack(">2HIH", 28, 1, 60, 16) + b"\0" * 15 + b"\1"
    root = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\0" + struct.pack(">2H", 1, 1)
    loop = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c"
    q, a, r, loop_, cut = packets(spark, *(ipv4(17, udp(5353, 53, x)) for x in (query, answer, root, loop, query[:8])))
    assert q["dns"]["query_name"] == "google.com" and q["dns"]["transaction_id"] == 0x1234 and q["issues"] == []
    assert a["dns"]["rcode"] == 3 and a["dns"]["answers"][0]["data"]["addr"] == "::1" and a["dns"]["answers"][0]["name"] == "google.com"
    assert issues(r) == issues(loop_)[:1] + [] or issues(r)[0][0] == "truncated"  # the root name counts as missing
    assert r["dns"]["query_name"] is None and loop_["dns"]["query_name"] is None
    assert cut["dns"] is None and issues(cut) == [("truncated", 50)]


def test_http_head(spark):
    request = b"GET /a b HTTP/1.1\r\nHost: one\r\nHOST:  two \r\nContent-Length: x\r\n\r\nHost: three"
    response = b"HTTP/1.0 70000 Odd\xff\nContent-Length: +5\n"
    q, r, other = packets(spark, *(ipv4(6, tcp(80, 1234, x)) for x in (request, response, b"GETX")))
    assert (q["http"]["method"], q["http"]["uri"], q["http"]["version"], q["http"]["host"], q["http"]["content_length"]) == ("GET", "/a", "b HTTP/1.1", "two", None)
    assert r["http"]["status_code"] is None and r["http"]["reason"] == "Odd?" and int(r["http"]["content_length"]) == 5
    assert other["http"] is None and other["protocol"] == "TCP"


def test_tls_is_partial_when_cut(spark):
    hello = bytes((0x16, 3, 1, 0, 90, 1, 0, 0, 86, 3, 3)) + b"\0" * 10
    (p,) = packets(spark, ipv4(6, tcp(9999, 8888, hello)))
    assert p["protocol"] == "TLS" and p["tls_client_hello"]["client_version"] == 0x0303 and issues(p) == [("truncated", 54 + len(hello))]


def test_random_bytes_never_fail(spark):
    rng = random.Random(5)
    data = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    data += [eth(rng.choice((0x0800, 0x0806, 0x86DD)), bytes([rng.choice((0x45, 0x60, 0x46))]) + bytes(rng.randrange(256) for _ in range(rng.randrange(0, 120)))) for _ in range(300)]
    base = bytearray(ipv4(6, tcp(80, 443, b"\x16\x03\x01\0\x50\x01\0\0\x4c\x03\x03" + b"\0" * 70)))
    for _ in range(150):
        base[rng.randrange(14, len(base))] = rng.randrange(256)
        data.append(bytes(base))
    got = packets(spark, *data)
    assert len(got) == len(data) and all((len(d) < 14) == (p["decode_error"] is not None) for d, p in zip(data, got, strict=True))


def test_no_rows(spark):
    assert dissect(frames(spark, ipv4(6, tcp(1, 2))).limit(0)).count() == 0
