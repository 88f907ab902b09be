"""Frames for tests, built by hand."""

import struct


def eth(kind: int, body: bytes) -> bytes:
    return bytes.fromhex("020000000002" "020000000001") + struct.pack(">H", kind) + body


def ones(data: bytes) -> int:
    data += b"\0" * (len(data) % 2)
    s = sum(struct.unpack(f">{len(data) // 2}H", data))
    while s > 0xFFFF:
        s = (s & 0xFFFF) + (s >> 16)
    return 0xFFFF - s


def ipv4(proto: int, body: bytes, total: int | None = None, frag: int = 0x4000, checksum: bool = False, src=(192, 0, 2, 10), dst=(198, 51, 100, 20), ihl: int = 5) -> bytes:
    head = struct.pack(">BBHHHBBH", 0x40 | ihl, 0, (total if total is not None else 4 * ihl + len(body)), 1, frag, 64, proto, 0) + bytes(src) + bytes(dst) + b"\1" * (4 * ihl - 20)
    if checksum:
        head = head[:10] + struct.pack(">H", ones(head)) + head[12:]
    return eth(0x0800, head + body)


def tcp(sport: int, dport: int, payload: bytes = b"", flags: int = 2, offset: int = 5, checksum: int = 0) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 0, offset << 4, flags, 1024, checksum, 0) + b"\0" * (4 * offset - 20) + payload


def udp(sport: int, dport: int, payload: bytes = b"", length: int | None = None, checksum: int = 0) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if length is None else length, checksum) + payload


def ipv6(next_header: int, body: bytes, plen: int | None = None) -> bytes:
    head = struct.pack(">IHBB", 6 << 28, len(body) if plen is None else plen, next_header, 64) + bytes.fromhex("20010db8000000000000000000000001" "20010db8000000000000000000000002")
    return eth(0x86DD, head + body)


def frames(spark, *data: bytes):
    rows = [("t", i, (i + 1) * 1_000_000_000, len(d), len(d), bytearray(d)) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "capture string, frame_no bigint, ts_ns bigint, cap_len int, orig_len bigint, data binary")
