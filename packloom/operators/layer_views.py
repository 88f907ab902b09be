"""Layers of packets as tagged objects: a VARIANT for each, which paths like $.flags.syn reach into.

Each object has the `type` of its layer, numbers as numbers, and names beside the ids that have some. Fields that a packet
lacks are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import answer_text, name_of


def _named(kind: str, number: Column) -> Column:
    return F.when(number.isNotNull(), F.struct(number.alias("id"), name_of(kind, number).alias("name")))


def _all_named(kind: str, numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.struct(x.alias("id"), name_of(kind, x).alias("name")))


def _icmp_detail(d: Column) -> Column:
    """What a message's kind has: echoes an identifier and a sequence, unreachable a next hop's MTU, others the rest of the header."""
    variant = lambda *fields: F.to_variant_object(F.struct(d["kind"].alias("type"), *[d[f].alias(f) for f in fields]))
    return F.when(d["kind"].isin("EchoRequest", "EchoReply"), variant("identifier", "sequence")).when(d["kind"] == "DestinationUnreachable", variant("next_hop_mtu")).when(d["kind"] == "Other", variant("rest_of_header"))


#: Each layer's tag, and its fields under their names where those differ from the columns'.
VIEWS = {
    "eth": ("Ethernet", {}), "arp": ("ARP", {"sender_protocol_addr": "sender", "target_protocol_addr": "target"}), "ipv4": ("IPv4", {}), "ipv6": ("IPv6", {}),
    "tcp": ("TCP", {"source_port": "src_port", "destination_port": "dst_port"}), "udp": ("UDP", {"source_port": "src_port", "destination_port": "dst_port"}), "icmp": ("ICMP", {"type_": "type"}),
    "dns": ("DNS", {}), "tls_client_hello": ("TlsClientHello", {}), "tls_server_hello": ("TlsServerHello", {}), "http": ("HTTP", {}),
}
_MADE = {
    ("icmp", "detail"): _icmp_detail,
    ("dns", "answers"): lambda c: F.transform(c, lambda a: F.struct(a["name"].alias("name"), a["record_type"].alias("record_type"), a["ttl"].alias("ttl"), answer_text(a).alias("data"))),
    ("tls_client_hello", "cipher_suites"): lambda c: _all_named("cipher_suite", c), ("tls_client_hello", "signature_algorithms"): lambda c: _all_named("signature_algorithm", c),
    ("tls_client_hello", "key_share_groups"): lambda c: _all_named("named_group", c), ("tls_server_hello", "cipher_suite"): lambda c: _named("cipher_suite", c), ("tls_server_hello", "key_share_group"): lambda c: _named("named_group", c),
    ("http", "content_length"): lambda c: c.cast("decimal(20,0)"),
}
_LEFT_OUT = {("tcp", "flag_bits")}


def layer_views(packets: DataFrame) -> Column:
    """The layers of a packet, outermost first, as an array of VARIANT objects. A packet without a layer has an empty array."""
    out = []
    for layer, (tag, renamed) in VIEWS.items():
        old = set(renamed.values())
        plain = {n: n for n in packets.schema[layer].dataType.names if n not in old and (layer, n) not in _LEFT_OUT}
        fields = [F.lit(tag).alias("type")]
        for name, column in (plain | renamed).items():
            value = F.col(f"{layer}.{column}")
            fields.append(_MADE.get((layer, column), lambda c: c)(value).alias(name))
        out.append(F.when(F.col(layer).isNotNull(), F.to_variant_object(F.struct(*fields))))
    return F.filter(F.array(*out), lambda v: v.isNotNull())
