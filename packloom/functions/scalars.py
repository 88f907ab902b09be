"""Scalar functions of packets as Columns: names, addresses, times and texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of numbers in protocols, "Unknown" for any other.
NAMES = {
    "cipher_suite": {0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256", 0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", 0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA", 0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256", 0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384", 0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384", 0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA"},
    "signature_algorithm": {0x0401: "rsa_pkcs1_sha256", 0x0501: "rsa_pkcs1_sha384", 0x0601: "rsa_pkcs1_sha512", 0x0403: "ecdsa_secp256r1_sha256", 0x0503: "ecdsa_secp384r1_sha384", 0x0804: "rsa_pss_rsae_sha256", 0x0805: "rsa_pss_rsae_sha384", 0x0806: "rsa_pss_rsae_sha512", 0x0807: "ed25519", 0x0808: "ed448"},
    "named_group": {0x0017: "secp256r1", 0x0018: "secp384r1", 0x0019: "secp521r1", 0x001D: "x25519", 0x001E: "x448", 0x0100: "ffdhe2048", 0x0101: "ffdhe3072"},
    "tls_version": {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"},
    "dns_qtype": {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA"},
    "dns_rcode": {0: "No Error", 1: "Format Error", 2: "Server Failure", 3: "NXDOMAIN", 4: "Not Implemented", 5: "Refused"},
    "ether_type": {0x0800: "IPv4", 0x0806: "ARP", 0x86DD: "IPv6"},
    "ip_protocol": {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"},
    "icmp_type": {0: "Echo Reply", 3: "Destination Unreachable", 8: "Echo Request", 11: "Time Exceeded", 128: "Echo Request (v6)", 129: "Echo Reply (v6)"},
    "arp_operation": {1: "Request", 2: "Reply"},
    "stream_protocol": {6: "TCP", 17: "UDP"},
}


def name_of(kind: str, number: Column) -> Column:
    """The name of a protocol number; null for null."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(NAMES[kind].items())])
    return F.when(number.isNotNull(), F.coalesce(F.try_element_at(known, number.cast("int")), F.lit("Unknown")))


def utc_text(ts_ns: Column) -> Column:
    """YYYY-MM-DDThh:mm:ss.mmmZ, milliseconds cut (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(F.call_function("div", ts_ns, F.lit(1_000_000))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    whole = F.floor(seconds).cast("long")
    h, m, s = (whole / 3600).cast("long"), ((whole % 3600) / 60).cast("long"), whole % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def mac_text(address: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(address), "(..)(?!$)", "$1:"))


def ip_text(family: Column, address: Column) -> Column:
    from ..operators.dissect import ipv6_text

    v4 = F.concat_ws(".", *[F.conv(F.hex(F.substring(address, i, 1)), 16, 10) for i in range(1, 5)])
    return F.when(family == 4, v4).otherwise(ipv6_text(address))


def with_port(address: Column, port: Column, bare_brackets: bool = True) -> Column:
    """address:port, IPv6 in brackets. Without a port IPv6 keeps its brackets, or (for
    imported tables: bare_brackets=False) the address stays as it is."""
    six = address.contains(":")
    shown = F.when(six, F.concat(F.lit("["), address, F.lit("]"))).otherwise(address)
    alone = shown if bare_brackets else address
    return F.when(address == "", F.lit("")).when(port.isNull(), alone).otherwise(F.concat(shown, F.lit(":"), port.cast("string")))


_PORT = r"^\+?0*(6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4})$"


def host_of(endpoint: Column) -> Column:
    """The host part of an endpoint text."""
    bracketed = F.regexp_extract(endpoint, r"^\[([^\]]*)\]", 1)
    port = F.regexp_extract(endpoint, r"^[^:]*:([^:]*)$", 1)
    return F.when(endpoint.rlike(r"^\[[^\]]*\]"), bracketed).when(port.rlike(_PORT), F.substring_index(endpoint, ":", 1)).otherwise(endpoint)


def port_of(endpoint: Column) -> Column:
    """The port of an endpoint text, null if there is none."""
    text = F.when(endpoint.startswith("["), F.regexp_extract(endpoint, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(F.regexp_extract(endpoint, r"^[^:]*:([^:]*)$", 1))
    return F.when(text.rlike(_PORT), F.regexp_replace(text, r"^\+", "").cast("int"))


def fold_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ascii(text: Column, part: str) -> Column:
    """Substring test that ignores the case of A-Z alone."""
    return F.contains(fold_ascii(text), fold_ascii(F.lit(part)))


def equals_ascii(text: Column, other: str) -> Column:
    return fold_ascii(text) == fold_ascii(F.lit(other))


def issue_text(kind: Column) -> Column:
    """checksum_mismatch as "Checksum mismatch"."""
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.regexp_replace(F.substring(kind, 2, 99), "_", " "))


def answer_text(answer: Column) -> Column:
    """A DNS answer's address, or the size of its data."""
    return F.coalesce(answer["data"]["addr"], F.concat(F.octet_length(answer["data"]["raw"]).cast("string"), F.lit(" bytes")))


def summary_line() -> Column:
    """The one-line text of a packet (columns number, time, protocol, source, destination, cap_len)."""
    return F.format_string("%4d  %-24s  %-5s  %-22s -> %-22s %4d", "number", "time", "protocol", "source", "destination", F.col("cap_len").cast("long"))


def hex_text(data: Column) -> Column:
    """Bytes as lowercase hexadecimal digits."""
    return F.lower(F.hex(data))


def hex_bytes(text: Column) -> Column:
    """The bytes of hexadecimal digits; an odd number of them, or another character, is an error."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(text)).otherwise(F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("no hex bytes: "), text)).cast("binary")))


def json_line(values: dict[str, Column], left_out: tuple[str, ...] = ()) -> Column:
    """A JSON object with the values in order. Nulls are written, but those of `left_out` are left out."""
    piece = lambda k, v: F.regexp_extract(F.to_json(F.struct(v.alias(k)), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)
    parts = [F.when(v.isNotNull(), piece(k, v)) if k in left_out else piece(k, v) for k, v in values.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
