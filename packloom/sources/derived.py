"""Captures derived from the `events` table: each event becomes an Ethernet frame.

The frames are real bytes, built by Spark expressions from the event's fields, so that every
query over them runs the dissectors. The recipe uses integer arithmetic alone, which makes
the fields easy to state in SQL as well (see packloom.queries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pcap import CaptureSource, CaptureWriter, pcap_record


def _hex(value, width: int) -> Column:
    """`value` as `width` hexadecimal digits."""
    return F.lpad(F.hex(F.expr(value).cast("long") if isinstance(value, str) else value.cast("long")), width, "0")


def _text(value: Column) -> Column:
    return F.hex(value)


def _words(text: Column) -> Column:
    """The sum of the 16-bit words that `text` has in hexadecimal digits; an odd last byte is a high one."""
    whole = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), "0")
    return F.aggregate(F.sequence(F.lit(1), F.length(whole) - 3, F.lit(4)), F.lit(0).cast("long"), lambda total, at: total + F.conv(F.substr(whole, at, F.lit(4)), 16, 10).cast("long"))


def event_fields(events: DataFrame) -> DataFrame:
    """The recipe's fields of each event."""
    out = events.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )
    return out.withColumns(
        {
            "kind": F.expr("case when event_id % 97 = 0 then 'arp' when event_id % 101 = 0 then 'other' when event_id % 103 = 0 then 'cut' when event_id % 109 = 0 then 'v6' else 'v4' end"),
            "bad": F.expr("event_id % 107 = 0"),
            "up": F.expr("event_id % 3 <> 2"),
            "server": F.expr("case when user_id % 2 = 0 then user_id % 9 else event_id % 9 end + 1"),
            "proto": F.expr("if(event_type = 'signup', 17, 6)"),
            "server_port": F.expr("case event_type when 'view' then 80 when 'click' then 443 when 'signup' then 53 when 'purchase' then 23 else 445 end"),
            "client_port": F.expr("49152 + user_id % 16384"),
            "rcode": F.expr("if(event_id % 3 = 2 and k < 50, 3, 0)"),
        }
    )


def _payload() -> Column:
    k, user = F.col("k").cast("string"), F.col("user_id").cast("string")
    request = F.concat(F.lit("GET /p/"), k, F.lit(" HTTP/1.1\r\nHost: u"), user, F.lit(".example.com\r\n\r\n"))
    response = F.concat(F.expr("if(k % 7 = 0, 'HTTP/1.1 404 Not Found', 'HTTP/1.1 200 OK')"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), k, F.lit("\r\n\r\n"))
    http = _text(F.when(F.col("up"), request).otherwise(response))

    # Lengths come from that of k, so that no part of a message stands in it twice.
    size = F.length(k)
    name = F.concat(_hex(size + 18, 4), _hex(size + 16, 4), F.lit("00"), _hex(size + 13, 4), _text(F.concat(F.lit("s"), k, F.lit(".example.net"))))
    hello = F.concat(F.lit("0303" + "00" * 32 + "00" + "0004" + "1301c02f" + "0100"), _hex(size + 31, 4), F.lit("0000"), name, F.lit("002b00050403040303"))
    client = F.concat(F.lit("160301"), _hex(size + 80, 4), F.lit("01"), _hex(size + 76, 6), hello)
    answer = F.lit("0303" + "00" * 32 + "00" + "1301" + "00" + "000e" + "002b00020304" + "00330004001d0000")
    server = F.concat(F.lit("160303" + "003a" + "02" + "000036"), answer)
    tls = F.when(F.col("up"), client).otherwise(server)

    label = lambda n, c: F.concat(_hex(n, 2), _text(c))
    long = F.when(F.expr("user_id % 25 = 0"), F.lit("3c" + "78" * 60)).otherwise(F.lit(""))
    qname = F.concat(long, label(size + 1, F.concat(F.lit("k"), k)), label(F.length(user) + 1, F.concat(F.lit("u"), user)), F.lit("076578616d706c6503636f6d00"))
    flags = F.when(F.col("up"), F.lit("0100")).otherwise(F.concat(F.lit("818"), _hex("rcode", 1)))
    answered = F.expr("not up and rcode = 0")
    dns = F.concat(
        _hex("event_id % 65536", 4), flags, F.lit("0001"), F.when(answered, F.lit("0001")).otherwise(F.lit("0000")), F.lit("00000000"),
        qname, _hex("if(k % 5 = 0, 16, 1)", 4), F.lit("0001"),
        F.when(answered, F.concat(F.lit("c00c000100010000012c0004cb0071"), _hex("k % 256", 2))).otherwise(F.lit("")),
    )
    kind = F.col("event_type")
    return F.when(kind == "view", http).when(kind == "click", tls).when(kind == "signup", dns).otherwise(F.lit(""))


def frames_from_events(events: DataFrame, capture: str = "events") -> DataFrame:
    """Rows of (capture, frame_no, packet_index, ts_ns, cap_len, orig_len, data), one for each event. Each
    frame has an Ethernet header, so packets are numbered as frames are."""
    f = event_fields(events).withColumn("payload", _payload())
    client4, server4 = F.concat(F.lit("0a00"), _hex("user_id div 16 % 256", 2), _hex("user_id % 16 + 1", 2)), F.concat(F.lit("c63364"), _hex("server", 2))
    client6, server6 = F.concat(F.lit("20010db8" + "0" * 16 + "000c"), _hex("user_id % 65536", 4)), F.concat(F.lit("20010db8" + "0" * 16 + "0005"), _hex("server", 4))
    way = lambda a, b: F.when(F.col("up"), F.concat(a, b)).otherwise(F.concat(b, a))
    ports = way(_hex("client_port", 4), _hex("server_port", 4))
    check = F.when(F.col("bad"), F.lit("0001")).otherwise(F.lit("0000"))
    bits = F.expr("case event_id % 16 when 0 then 2 when 1 then 18 when 2 then 4 when 3 then 17 else if(payload <> '', 24, 16) end")
    tcp = F.concat(ports, _hex("event_id * 1460 % 4294967296", 8), F.lit("00000000" + "50"), _hex(bits, 2), F.lit("0400"), check, F.lit("0000"), F.col("payload"))
    udp = F.concat(ports, _hex(F.length("payload") / 2 + 8, 4), check, F.col("payload"))
    f = f.withColumn("segment", F.when(F.col("proto") == 6, tcp).otherwise(udp))
    # A wrong checksum of 1 that happens to be right becomes 2.
    pseudo = _words(F.when(F.col("kind") == "v6", way(client6, server6)).otherwise(way(client4, server4))) + F.col("proto") + F.length("segment") / 2
    right = F.when(F.col("bad"), (pseudo + _words(F.col("segment"))) % 0xFFFF == 0)
    f = f.withColumn("segment", F.when(right, F.overlay("segment", F.lit("0002"), F.when(F.col("proto") == 6, 33).otherwise(13), 4)).otherwise(F.col("segment")))
    v4 = F.concat(F.lit("0800" + "4500"), _hex(F.length("segment") / 2 + 20, 4), _hex("event_id % 65536", 4), F.lit("4000"), _hex("32 + k % 224", 2), _hex("proto", 2), F.lit("0000"), way(client4, server4), F.col("segment"))
    v6 = F.concat(F.lit("86dd" + "60000000"), _hex(F.length("segment") / 2, 4), _hex("proto", 2), _hex("32 + k % 224", 2), way(client6, server6), F.col("segment"))
    arp = F.concat(F.lit("0806" + "0001080006040001"), F.lit("020000000001"), client4, F.lit("000000000000"), server4)
    other = F.lit("88b5" + "00" * 46)
    kind = F.col("kind")
    body = F.when(kind == "arp", arp).when(kind == "other", other).when(kind == "v6", v6).otherwise(v4)
    whole = F.unhex(F.concat(way(F.lit("020000000001"), F.lit("020000000002")), body))
    return _frames(f.withColumn("whole", whole), capture, F.when(kind == "cut", F.substring("whole", 1, 30)).otherwise(F.col("whole")))


def _frames(f: DataFrame, capture: str, data: Column) -> DataFrame:
    return f.withColumn("data", data).select(
        F.lit(capture).alias("capture"), F.col("event_id").alias("frame_no"), F.col("event_id").alias("packet_index"), (F.col("us") * 1000).alias("ts_ns"),
        F.octet_length("data").cast("int").alias("cap_len"), F.octet_length("whole").cast("long").alias("orig_len"), "data",
    )


def odd_frames_from_events(events: DataFrame, capture: str = "odd") -> DataFrame:
    """A second capture of the same events, of what the first one has none: by event_id % 16 there are
    ICMP messages (0: echo request, 1: destination unreachable, 2: brief), first and later IPv4
    fragments (3, 4), IPv6 packets behind a hop-by-hop header (5) and of a later fragment (6), IPv4
    headers with a right or wrong checksum before a DNS answer with a compressed name and an
    AAAA record (7), and frames cut after 30 bytes (8 to 15)."""
    f = event_fields(events).withColumn("part", F.expr("event_id % 16"))
    part, zeros = F.col("part"), lambda n: F.lit("00" * n)
    icmp = F.when(part == 0, F.concat(F.lit("08000000"), _hex("user_id % 65536", 4), _hex("event_id % 65536", 4), _hex("k", 4))).when(part == 1, F.concat(F.lit("030400000000"), _hex("576 + k", 4), zeros(8))).otherwise(F.lit("0b000000"))
    udp = F.concat(_hex("client_port", 4), F.lit("270f"), F.lit("0010" + "0000" + "00" * 8))
    tcp = F.concat(_hex("client_port", 4), F.lit("01bb"), _hex("event_id", 8), F.lit("00000000" + "5002" + "0400" + "00000000"))
    name = F.concat(_hex("length(k) + 1", 2), _text(F.concat(F.lit("h"), F.col("k").cast("string"))), F.lit("076578616d706c6503636f6d00"))
    answer = F.concat(F.lit("c00c" + "001c0001" + "0000012c" + "0010" + "20010db8" + "00" * 8), _hex("user_id % 4294967296", 8))
    dns = F.concat(_hex("event_id % 65536", 4), F.lit("8180" + "00010001" + "00000000"), name, F.lit("001c0001"), answer)
    f = f.withColumn("dns", dns)
    dns = F.concat(F.lit("0035"), _hex("client_port", 4), _hex(F.length("dns") / 2 + 8, 4), F.lit("0000"), F.col("dns"))
    body = F.when(part <= 2, icmp).when(part == 7, dns).otherwise(udp)
    f = f.withColumn("body", body)
    address = lambda tail: F.concat(F.lit("c000"), _hex("user_id % 65536", 4) if tail else F.lit("0201"))
    head = lambda check: F.concat(
        F.lit("4500"), _hex(F.length("body") / 2 + 20, 4), _hex("event_id % 65536", 4), F.when(part == 3, F.lit("2000")).when(part == 4, F.lit("0010")).otherwise(F.lit("4000")),
        F.lit("40"), F.when(part <= 2, F.lit("01")).otherwise(F.lit("11")), check, address(True), address(False))
    # The sum of the header's words as they stand in `head`, and its complement.
    total = F.expr("17664 + length(body) div 2 + 20 + event_id % 65536 + 16384 + 16401 + 49152 + user_id % 65536 + 49152 + 513")
    for _ in range(3):
        total = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftrightunsigned(total, 16)
    check = F.when(part == 7, F.when(F.expr("k % 3 = 0"), F.lit("1234")).otherwise(_hex(F.lit(0xFFFF) - total, 4))).otherwise(F.lit("0000"))
    six = lambda kind, middle, body: F.concat(F.lit("60000000"), _hex((F.length(middle) + F.length(body)) / 2, 4), F.lit(kind), F.lit("40"), F.lit("20010db8" + "00" * 10), _hex("user_id % 65536", 4), F.lit("20010db8" + "00" * 11 + "01"), middle, body)
    hop, fragment = F.lit("0600" + "00" * 6), F.concat(F.lit("0600" + "0010"), _hex("event_id", 8))
    packet = F.when(part == 5, F.concat(F.lit("86dd"), six("00", hop, tcp))).when(part == 6, F.concat(F.lit("86dd"), six("2c", fragment, tcp))).otherwise(F.concat(F.lit("0800"), head(check), F.col("body")))
    f = f.withColumn("whole", F.unhex(F.concat(F.lit("020000000001020000000002"), packet)))
    return _frames(f, capture, F.when(part >= 8, F.substring("whole", 1, 30)).otherwise(F.col("whole")))


def http_frames_from_events(events: DataFrame, capture: str = "http") -> DataFrame:
    """A third capture: each user's views as messages of one HTTP conversation in each direction. Messages have bodies of a length or in
    chunks, and are cut into segments of 160 bytes that repeat the 40 before them. Users of the same port have
    different addresses. Every fifth segment comes twice,
    neighbours have changed places, and sequence numbers start 700 before 2 ** 32."""
    f = event_fields(events).filter("event_type = 'view'").withColumns({"size": F.expr("k * 37 % 900"), "chunks": F.expr("k % 40 + 1")})
    chunked = F.expr("not up and k % 3 = 1")
    head = F.when(F.col("up"), F.concat(F.lit("POST /p/"), F.col("k"), F.lit(" HTTP/1.1\r\nHost: u"), F.col("user_id"), F.lit(".example.com\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))).when(
        chunked, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\n\r\n")
    ).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n")))
    body = F.when(chunked, F.concat(F.repeat(F.lit("a\r\nyyyyyyyyyy\r\n"), F.col("chunks").cast("int")), F.lit("0\r\n\r\n"))).otherwise(F.repeat(F.lit("x"), F.col("size").cast("int")))
    f = f.withColumn("message", F.concat(head, body)).withColumn("length", F.length("message"))
    before = Window.partitionBy("user_id", "up").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    f = f.withColumn("i", F.explode(F.expr("sequence(0, (length - 1) div 160)"))).withColumn("copy", F.explode(F.expr("sequence(0, if(i % 5 = 0, 1, 0))")))
    f = f.withColumn("start", F.expr("greatest(i * 160 - 40, 0)")).withColumn("part", F.expr("substring(message, start + 1, (i + 1) * 160 - start)"))
    client, server = F.concat(F.lit("0a"), _hex("user_id div 16384 % 16777215 + 1", 6)), F.lit("c6336401")
    way = lambda a, b: F.when(F.col("up"), F.concat(a, b)).otherwise(F.concat(b, a))
    tcp = F.concat(way(_hex("client_port", 4), F.lit("0050")), _hex("(4294966596 + offset + start) % 4294967296", 8), F.lit("00000000" + "5018" + "0400" + "00000000"), F.hex("part"))
    ip = F.concat(F.lit("0800" + "4500"), _hex(F.length("part") + 40, 4), F.lit("0000" + "4000" + "4006" + "0000"), way(client, server), tcp)
    f = f.withColumn("event_id", F.expr("event_id * 10000 + (i ^ 1) * 2 + copy")).withColumn("whole", F.unhex(F.concat(F.lit("020000000001020000000002"), ip)))
    return _frames(f, capture, F.col("whole"))


class DamagedWriter(CaptureWriter):
    """Pcaps whose frames with `damaged` have record headers of a size that can't be, and noise for data."""

    def put(self, f, batch) -> None:
        for ts, data, original, damaged in zip(*(batch.column(c).to_pylist() for c in ("ts_ns", "data", "orig_len", "damaged")), strict=True):
            whole = pcap_record(ts, data, original)
            f.write(whole[:8] + b"\xff" * (len(whole) - 8) if damaged else whole)


class DamagedCaptures(CaptureSource):
    @classmethod
    def name(cls):
        return "damaged-capture"

    def writer(self, schema, overwrite):
        return DamagedWriter(self.options["path"], overwrite)
