"""Dissectors: frames to packets, one nullable struct column per protocol layer.

A batch of frames is decoded at once: every header field is one gather over the batch's bytes,
and a layer's rules are masks over its rows. Only what has a variable shape (DNS names, TLS
extensions, HTTP heads, texts of IPv6 addresses) is done row by row, for the rows that have it,
and only the columns that are asked for are made. The step is one Arrow map without a shuffle,
so it scales with the frames' partitions.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wire

ETH = 14
# Fixed value: it changes what is decoded.
MAX_EXTENSION_HEADERS = 16
ABSENT, OK, CUT, MALFORMED = 0, 1, 2, 3

LAYERS = {
    "eth": "struct<destination:string,source:string,ether_type:int>",
    "arp": "struct<operation:int,sender:string,target:string>",
    "ipv4": "struct<source:string,destination:string,protocol:int,ttl:int,identification:int,dscp:int,ecn:int,dont_fragment:boolean,fragment_offset:int,more_fragments:boolean,header_checksum:int>",
    "ipv6": "struct<source:string,destination:string,next_header:int,traffic_class:int,flow_label:bigint,hop_limit:int>",
    "tcp": "struct<src_port:int,dst_port:int,seq:bigint,ack:bigint,data_offset:int,flags:struct<fin:boolean,syn:boolean,rst:boolean,psh:boolean,ack:boolean,urg:boolean,ece:boolean,cwr:boolean>,flag_bits:int,window:int>",
    "udp": "struct<src_port:int,dst_port:int,length:int>",
    "icmp": "struct<type:int,code:int,detail:struct<kind:string,identifier:int,sequence:int,next_hop_mtu:int,rest_of_header:bigint>>",
    "dns": wire.DNS.replace(",short:boolean", ""),
    "tls_client_hello": wire.CLIENT,
    "tls_server_hello": wire.SERVER,
    "http": "struct<is_request:boolean,method:string,uri:string,version:string,status_code:int,reason:string,host:string,content_type:string,content_length:decimal(20,0)>",
}
# What layers are called.
LAYER_NAMES = {"eth": "Ethernet", "arp": "ARP", "ipv4": "IPv4", "ipv6": "IPv6", "tcp": "TCP", "udp": "UDP", "icmp": "ICMP", "dns": "DNS", "tls_client_hello": "TLS", "tls_server_hello": "TLS", "http": "HTTP"}
#: A stream's key: family, the lesser end's address (v4 in the first 4 of 16 bytes) and port, the other's, protocol.
_KEY = np.dtype([("family", "u1"), ("a1", ">u8"), ("a2", ">u8"), ("p", ">u2"), ("b1", ">u8"), ("b2", ">u8"), ("q", ">u2"), ("proto", "u1")])
PACKET = {
    "decode_error": "string", "protocol": "string", "source": "string", "destination": "string", "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int",
    "payload_at": "int", "payload_len": "int", "layer_names": "array<string>", "spans": "array<struct<offset:int,len:int>>", "issues": "array<struct<kind:string,offset:int>>", "stream_key": "binary", **LAYERS,
}
#: Plain values of a frame's headers that a scan can be filtered by: the ether type and IP protocol of the layers that
#: decode, addresses and ports, and both of each between commas.
HEADER = {"network": "int", "transport": "int", "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "hosts": "string", "ports": "string"}
_DECIMAL, _HEX = pa.array([str(i) for i in range(256)]), pa.array([f"{i:02x}" for i in range(256)])
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class _Frames:
    """A batch's bytes with gathers that never leave a frame; what lies outside reads as 0."""

    def __init__(self, column: pa.Array):
        column = column.fill_null(b"").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        self.base, self.size, self.past = at[:-1] - at[0], np.diff(at), at[1:] - at[0]
        self.raw = np.append(raw, np.zeros(8, np.uint8))
        self.lanes = np.ndarray((len(raw) + 1,), "<u8", self.raw, strides=(1,))

    def eight(self, at) -> np.ndarray:
        """The eight bytes at `at`, the first one lowest."""
        where = self.base + at
        return self.lanes[np.minimum(where, len(self.lanes) - 1)] & _FIRST_BYTES[np.clip(self.past - where, 0, 8)]

    def u(self, at, width: int = 1) -> np.ndarray:
        return (self.eight(at).byteswap() >> np.uint64(64 - 8 * width)).astype(np.int64)

    def cut(self, mask: np.ndarray, start, length) -> list[bytes | None]:
        """Bytes of the masked rows, None for the others."""
        out: list[bytes | None] = [None] * len(mask)
        s = np.broadcast_to(self.base + start, mask.shape)
        e = np.minimum(s + length, self.past)
        for i in np.flatnonzero(mask).tolist():
            out[i] = self.raw[s[i] : e[i]].tobytes()
        return out

    def sums(self, start, length, mask: np.ndarray) -> np.ndarray:
        """Sums of the 16-bit words of the masked rows' stretches; an odd last byte is a high one."""
        out = np.zeros(len(mask), np.int64)
        s = np.broadcast_to(self.base + start, mask.shape)[mask]
        n = np.broadcast_to(np.asarray(length), mask.shape)[mask]
        if len(s):
            past = np.cumsum(n)
            place = np.arange(past[-1]) - np.repeat(past - n, n)
            b = self.raw[np.repeat(s, n) + place].astype(np.int64)
            total = np.append(0, np.cumsum(np.where(place & 1 == 0, b << 8, b)))
            out[mask] = total[past] - total[past - n]
        return out


def _folds_wrong(total: np.ndarray) -> np.ndarray:
    for _ in range(4):
        total = (total & 0xFFFF) + (total >> 16)
    return total != 0xFFFF


def _struct(mask: np.ndarray, kind: pa.DataType, values: list) -> pa.Array:
    """A struct column that is null outside the mask. values: arrays in the order of the fields."""
    arrays = []
    for v, f in zip(values, kind, strict=True):
        if isinstance(v, np.ndarray) and v.dtype != object:
            v = pa.array(v.astype(bool) if pa.types.is_boolean(f.type) else v, f.type)
        elif not isinstance(v, (pa.Array, pa.ChunkedArray)):
            v = pa.array(list(v), f.type)
        arrays.append(v)
    return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array(~mask))


def _lists(masks: list[np.ndarray], item: pa.DataType, columns: list[list]) -> pa.Array:
    """Per row the items of the masks that hold, in order. columns: one list of per-mask values (a
    text, or numbers by row) for each field of the item, or for the item itself."""
    held = np.stack(masks, axis=1)
    offsets = np.append(0, np.cumsum(held.sum(axis=1))).astype(np.int32)
    row, which = np.nonzero(held)
    arrays = []
    for values, f in zip(columns, [item] if not pa.types.is_struct(item) else [f.type for f in item], strict=True):
        if isinstance(values[0], str):
            arrays.append(pa.array(values, f).take(pa.array(which)))
        else:
            arrays.append(pa.array(np.stack([np.broadcast_to(v, len(held)) for v in values])[which, row], f))
    items = pa.StructArray.from_arrays(arrays, fields=list(item)) if pa.types.is_struct(item) else arrays[0]
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def decoded(b: pa.RecordBatch, kinds: dict[str, pa.DataType], wanted: list[str]) -> list[pa.Array]:
    """Columns of PACKET and HEADER for a batch of frames; kinds: their types, as far as they are structs or lists."""
    f = _Frames(b.column("data"))
    u, rows = f.u, len(f.base)
    eth, size = f.size >= ETH, f.size - ETH
    kind = np.where(eth, u(12, 2), -1)

    # Network layer.
    state = lambda here, *tests: np.where(here, np.select([t for t, _ in tests], [s for _, s in tests], OK), ABSENT)
    arp = state(kind == 0x0806, (size < 28, CUT), ((u(ETH, 4) != 0x00010800) | (u(ETH + 4, 2) != 0x0604), MALFORMED))
    first, total = u(ETH), u(ETH + 2, 2)
    ihl = (first & 15) * 4
    v4 = state(kind == 0x0800, (size < 20, CUT), ((first >> 4 != 4) | (ihl < 20), MALFORMED), (size < ihl, CUT), (total < ihl, MALFORMED))
    v6 = state(kind == 0x86DD, (size < 40, CUT), (first >> 4 != 6, MALFORMED))
    is4, is6 = v4 == OK, v6 == OK
    ip = is4 | is6
    declared = np.where(is4, total, u(ETH + 4, 2) + 40)
    end = np.minimum(declared, size)
    proto, at = np.where(is4, u(ETH + 9), u(ETH + 6)), np.where(is4, ihl, 40)
    frag = u(ETH + 6, 2)
    later, split = is4 & (frag & 0x1FFF != 0), is4 & (frag & 0x3FFF != 0)
    walking = is6.copy()
    for _ in range(MAX_EXTENSION_HEADERS):
        fragment = proto == 44
        length = np.where(fragment, 8, (u(ETH + at + 1) + 1) * 8)
        walking &= np.isin(proto, (0, 43, 44, 60)) & (at + 2 <= end) & (at + length <= end)
        if not walking.any():
            break
        word = u(ETH + at + 2, 2)
        hit = walking & fragment
        later |= hit & (word >> 3 != 0)
        split = np.where(hit, (word >> 3 != 0) | (word & 1 != 0), split)
        proto, at = np.where(walking, u(ETH + at), proto), np.where(walking, at + length, at)
    length, at = np.where(ip, end - at, 0), at + ETH
    has = ip & (length > 0) & ~later

    # Transport layer.
    head = (u(at + 12) >> 4) * 4
    tcp = state(has & (proto == 6), (length < 20, CUT), (head < 20, MALFORMED), (length < head, CUT))
    udp = state(has & (proto == 17), (length < 8, CUT), (u(at + 4, 2) < 8, MALFORMED))
    icmp = state(has & np.isin(proto, (1, 58)), (length < 4, CUT))
    is_tcp, is_udp, is_icmp = tcp == OK, udp == OK, icmp == OK
    ports = is_tcp | is_udp
    src, dst = u(at, 2), u(at + 2, 2)
    head = np.where(is_tcp, head, 8)
    app = at + head
    n = np.where(is_tcp, length - head, np.where(is_udp, np.minimum(u(at + 4, 2) - 8, length - 8), 0))

    # Application layer.
    dns = is_udp & (n > 0) & ((src == 53) | (dst == 53))
    hello = is_tcp & (n >= 9) & (u(app, 2) == 0x1603) & (u(app + 2) <= 3) & np.isin(u(app + 5), (1, 2))
    client, server = hello & (u(app + 5) == 1), hello & (u(app + 5) == 2)
    maybe_http = is_tcp & ~hello & (n >= 4)
    head8 = f.eight(app)
    http = np.zeros(rows, bool)
    for start in wire.HTTP_STARTS:
        http |= maybe_http & (n >= len(start)) & (head8 & _FIRST_BYTES[len(start)] == np.uint64(int.from_bytes(start, "little")))
    decode = lambda mask, how: [None if x is None else how(x) for x in f.cut(mask, app, n)]
    dns_full = dns & (n >= 12)
    messages = cache(lambda: decode(dns_full, wire.dns))
    tls_short = hello & ((n < u(app + 6, 3) + 9) | (n < 44))

    # Checksums: also of transports whose header is malformed, but only of whole segments.
    @cache
    def checksums() -> tuple[np.ndarray, np.ndarray]:
        bad4 = is4 & (u(ETH + 10, 2) != 0)
        bad4 &= _folds_wrong(f.sums(ETH, np.where(bad4, ihl, 0), bad4))
        summed = has & ~split & (((proto == 6) & (length >= 18)) | ((proto == 17) & (length >= 8)))
        field = np.where(proto == 6, u(at + 16, 2), u(at + 6, 2))
        check = summed & (field != 0)
        pseudo = np.where(is4, sum(u(ETH + i, 2) for i in range(12, 20, 2)), sum(u(ETH + i, 2) for i in range(8, 40, 2))) + proto + (length >> 16) + (length & 0xFFFF)
        return bad4, (check & _folds_wrong(f.sums(at, np.where(check, length, 0), check) + pseudo)) | (summed & (field == 0) & is6 & (proto == 17))

    # Columns, each made when it is asked for.
    arped = arp == OK
    chosen = lambda mask, then, other: pc.if_else(pa.array(mask), then, other)
    nothing = pa.scalar(None, pa.string())
    octets = lambda table, start, k, by: pc.binary_join_element_wise(*[table.take(pa.array(u(start + i))) for i in range(k)], by)
    dotted = cache(lambda start: octets(_DECIMAL, start, 4, "."))
    six = cache(lambda start: pa.array([None if x is None else str(ipaddress.IPv6Address(x)) for x in f.cut(is6, start, 16)], pa.string()))
    mac = lambda start: chosen(eth, octets(_HEX, start, 6, ":"), nothing)
    host = cache(lambda x4, x6: chosen(is4, dotted(ETH + x4), six(ETH + x6)))
    number = lambda v: pa.array(v, pa.int64(), mask=~ports).cast(pa.int32())
    optional = lambda mask, v: pa.array(v, mask=~mask)

    def shown(x4: int, x6: int, xa: int, port: np.ndarray) -> pa.Array:
        alone = chosen(is6, pc.binary_join_element_wise("[", six(ETH + x6), "]", ""), chosen(is4, dotted(ETH + x4), chosen(arped, dotted(ETH + xa), "")))
        return chosen(ports, pc.binary_join_element_wise(alone, pa.array(port).cast(pa.string()), ":"), alone)

    def stream_key() -> pa.Array:
        ends = []
        for x4, x6, port in ((12, 8, src), (16, 24, dst)):
            four = f.eight(ETH + x4) & _FIRST_BYTES[4]
            ends.append((np.where(is4, four, f.eight(ETH + x6)).byteswap(), np.where(is4, np.uint64(0), f.eight(ETH + x6 + 8)).byteswap(), port))
        (a1, a2, p), (b1, b2, q) = ends
        swap = (a1 > b1) | ((a1 == b1) & ((a2 > b2) | ((a2 == b2) & (p > q))))
        out = np.zeros(rows, _KEY)
        out["family"], out["proto"] = np.where(is4, 4, 6), np.where(is4, u(ETH + 9), u(ETH + 6))
        for low, high, x, y in (("a1", "b1", a1, b1), ("a2", "b2", a2, b2), ("p", "q", p, q)):
            out[low], out[high] = np.where(swap, y, x), np.where(swap, x, y)
        whole = pa.Array.from_buffers(pa.binary(_KEY.itemsize), rows, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
        return chosen(ports, whole, pa.scalar(None, pa.binary()))

    def tcp_layer() -> pa.Array:
        bits = u(at + 13)
        flags = _struct(is_tcp, kinds["tcp"].field("flags").type, [(bits >> i) & 1 for i in range(8)])
        return _struct(is_tcp, kinds["tcp"], [src, dst, u(at + 4, 4), u(at + 8, 4), head // 4, flags, bits, u(at + 14, 2)])

    def icmp_layer() -> pa.Array:
        type_, high, low = u(at), u(at + 4, 2), u(at + 6, 2)
        echo = np.isin(type_, (0, 8))
        detail = _struct(is_icmp & (length >= 8), kinds["icmp"].field("detail").type, [
            np.select([type_ == 0, type_ == 3, type_ == 8], ["EchoReply", "DestinationUnreachable", "EchoRequest"], "Other").astype(object),
            optional(echo, high).cast(pa.int32()), optional(echo, low).cast(pa.int32()), optional(type_ == 3, low).cast(pa.int32()), optional(~echo & (type_ != 3), u(at + 4, 4))])
        return _struct(is_icmp, kinds["icmp"], [type_, u(at + 1), detail])

    present = {"eth": eth, "arp": arped, "ipv4": is4, "ipv6": is6, "tcp": is_tcp, "udp": is_udp, "icmp": is_icmp, "dns": dns_full, "tls_client_hello": client, "tls_server_hello": server, "http": http}

    def protocol() -> pa.Array:
        which = np.full(rows, -1)
        for k, mask in enumerate(present.values()):
            which[mask] = k
        names = ["Unknown", *list(LAYER_NAMES.values())[1:]]
        return pa.array(names).take(pa.array(which, mask=which < 0))

    def issues() -> pa.Array:
        whole, past, app_end = size + ETH, at + length, app + n
        bad4, bad = checksums()
        dns_short = np.array([bool(m and m["short"]) for m in messages()], bool) | (dns & ~dns_full)
        found = []
        for s, layer, until in ((arp, ETH, whole), (v4, ETH, whole), (v6, ETH, whole)):
            found += [(s == CUT, "truncated", until), (s == MALFORMED, "malformed", layer)]
        found += [(ip & (size < declared), "truncated", whole), (bad4, "checksum_mismatch", ETH)]
        for s in (tcp, udp, icmp):
            found += [(s == CUT, "truncated", past), (s == MALFORMED, "malformed", at)]
        found += [(bad, "checksum_mismatch", at), (tls_short | dns_short, "truncated", app_end)]
        return _lists([m for m, _, _ in found], kinds["issues"].value_type, [[k for _, k, _ in found], [np.asarray(o) for _, _, o in found]])

    def spans() -> pa.Array:
        found = [(eth, 0, ETH), (arped, ETH, 28), (ip, ETH, at - ETH), (ports, at, head), (is_icmp, at, np.where(length >= 8, 8, 4)), (dns_full | hello | http, app, n)]
        return _lists([m for m, _, _ in found], kinds["spans"].value_type, [[np.asarray(x) for _, x, _ in found], [np.asarray(x) for _, _, x in found]])

    make = {
        "decode_error": lambda: pa.array(["truncated Ethernet header"]).take(pa.array(np.zeros(rows, np.int64), mask=eth)), "protocol": protocol,
        "source": lambda: shown(12, 8, 14, src), "destination": lambda: shown(16, 24, 24, dst), "src_ip": lambda: host(12, 8), "dst_ip": lambda: host(16, 24), "src_port": lambda: number(src), "dst_port": lambda: number(dst),
        "network": lambda: pa.array(kind, mask=~(ip | arped)), "transport": lambda: pa.array(proto, mask=~(ports | is_icmp)),
        "hosts": lambda: pc.binary_join_element_wise("", host(12, 8), host(16, 24), "", ","), "ports": lambda: pc.binary_join_element_wise("", number(src).cast(pa.string()), number(dst).cast(pa.string()), "", ","),
        "payload_at": lambda: number(app), "payload_len": lambda: number(n), "layer_names": lambda: _lists(list(present.values()), pa.string(), [[LAYER_NAMES[k] for k in present]]),
        "spans": spans, "issues": issues, "stream_key": stream_key,
        "eth": lambda: _struct(eth, kinds["eth"], [mac(0), mac(6), kind]), "arp": lambda: _struct(arped, kinds["arp"], [u(ETH + 6, 2), dotted(ETH + 14), dotted(ETH + 24)]),
        "ipv4": lambda: _struct(is4, kinds["ipv4"], [dotted(ETH + 12), dotted(ETH + 16), u(ETH + 9), u(ETH + 8), u(ETH + 4, 2), u(ETH + 1) >> 2, u(ETH + 1) & 3, frag >> 14 & 1, frag & 0x1FFF, frag >> 13 & 1, u(ETH + 10, 2)]),
        "ipv6": lambda: _struct(is6, kinds["ipv6"], [six(ETH + 8), six(ETH + 24), u(ETH + 6), u(ETH, 2) >> 4 & 255, u(ETH, 4) & 0xFFFFF, u(ETH + 7)]),
        "tcp": tcp_layer, "udp": lambda: _struct(is_udp, kinds["udp"], [src, dst, u(at + 4, 2)]), "icmp": icmp_layer,
        "dns": lambda: pa.array(messages(), kinds["dns"]), "tls_client_hello": lambda: pa.array(decode(client, wire.client_hello), kinds["tls_client_hello"]),
        "tls_server_hello": lambda: pa.array(decode(server, wire.server_hello), kinds["tls_server_hello"]), "http": lambda: pa.array(decode(http, wire.http_head), kinds["http"]),
    }
    return [make[k]() for k in wanted]


def _run(given: list[str], kinds: dict[str, pa.DataType], wanted: list[str]):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), *(a.cast(kinds[k]) for k, a in zip(wanted, decoded(b, kinds, wanted), strict=True))], [*given, *wanted])

    return run


def dissect(frames: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Packets of frames (which have a binary column `data`): the frames' other columns, then those
    of PACKET; or those of `columns` alone (`data` too, if it is one), of which the others are neither read nor decoded.

    decode_error is set, with no layer, if even the Ethernet header is cut or missing. Issues
    stand in the order in which a decoder meets them."""
    from pyspark.sql.pandas.types import to_arrow_type

    asked = None if columns is None else set(columns)
    if asked is not None and (unknown := asked - set(PACKET) - set(frames.columns)):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    given = [c for c in frames.columns if (c != "data" if asked is None else c in asked)]
    wanted = [k for k in PACKET if asked is None or k in asked]
    types = {k: T._parse_datatype_string(v) for k, v in PACKET.items()}
    schema = T.StructType([*(frames.schema[c] for c in given), *(T.StructField(k, types[k]) for k in wanted)])
    return frames.select(*dict.fromkeys([*given, "data"])).mapInArrow(_run(given, {k: to_arrow_type(v) for k, v in types.items()}, wanted), schema)


def ipv6_text(address: Column) -> Column:
    """RFC 5952 text of 16 bytes: the longest run of zero groups, the first of equals, is ::"""
    groups = F.array(*[F.lower(F.conv(F.hex(F.substring(address, 2 * i + 1, 2)), 16, 16)) for i in range(8)])

    def shortened(full: Column) -> Column:
        short = full
        for k in range(2, 9):  # later ones win, so longer runs do
            run = rf"^(.*?)(^|:)0(:0){{{k - 1}}}(:|$)(.*)$"
            short = F.when(full.rlike(run), F.regexp_replace(full, run, "$1::$5")).otherwise(short)
        return short

    # A variable of a lambda stands for the full text, which so is worked out once.
    short = F.get(F.transform(F.array(F.array_join(groups, ":")), shortened), F.lit(0))
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[F.conv(F.hex(F.substring(address, 13 + i, 1)), 16, 10) for i in range(4)]))
    return F.when(F.hex(F.substring(address, 1, 12)) == "0" * 20 + "FFFF", mapped).otherwise(short)
