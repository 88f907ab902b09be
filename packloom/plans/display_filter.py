"""Display filters ("tcp and port 443", `ip.ttl > 64`) as Column expressions.

Filters have two truth values: a comparison with a missing field is false, and so its negation
is true. In SQL a missing field gives null, which filters out alike, so that comparisons stay
bare and can be pushed down; only a comparison under an odd number of negations is made
false where it is null.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import fold_ascii
from ..operators.dissect import LAYERS

DEPTH = 128
# Protocols and fields that filters know, with the fields' types.
PROTOCOLS = {"tcp": ["tcp"], "udp": ["udp"], "arp": ["arp"], "icmp": ["icmp"], "ip": ["ipv4"], "ipv6": ["ipv6"], "eth": ["eth"], "ethernet": ["eth"], "dns": ["dns"], "tls": ["tls_client_hello", "tls_server_hello"], "http": ["http"]}
FIELDS = {
    "frame.len": ("int", "orig_len"), "frame.cap_len": ("int", "cap_len"), "tcp.stream": ("int", "if(tcp is not null, stream_id, null)"), "udp.stream": ("int", "if(udp is not null, stream_id, null)"),
    "ip.src": ("addr", "src_ip"), "ip.dst": ("addr", "dst_ip"), "ip.ttl": ("int", "ipv4.ttl"), "ip.id": ("int", "ipv4.identification"), "ip.proto": ("int", "ipv4.protocol"), "ip.dscp": ("int", "ipv4.dscp"), "ip.ecn": ("int", "ipv4.ecn"), "ip.checksum": ("int", "ipv4.header_checksum"), "ip.frag_offset": ("int", "ipv4.fragment_offset"), "ip.flags.df": ("bool", "ipv4.dont_fragment"), "ip.flags.mf": ("bool", "ipv4.more_fragments"),
    "ipv6.hlim": ("int", "ipv6.hop_limit"), "ipv6.flow": ("int", "ipv6.flow_label"), "ipv6.tc": ("int", "ipv6.traffic_class"), "ipv6.nxt": ("int", "ipv6.next_header"),
    "tcp.srcport": ("int", "tcp.src_port"), "tcp.dstport": ("int", "tcp.dst_port"), "tcp.seq": ("int", "tcp.seq"), "tcp.ack": ("int", "tcp.ack"), "tcp.window": ("int", "tcp.window"), "tcp.hdr_len": ("int", "tcp.data_offset * 4"), "tcp.port": ("pair", "tcp"),
    "tcp.flags.syn": ("bool", "tcp.flags.syn"), "tcp.flags.ack": ("bool", "tcp.flags.ack"), "tcp.flags.fin": ("bool", "tcp.flags.fin"), "tcp.flags.rst": ("bool", "tcp.flags.rst"), "tcp.flags.psh": ("bool", "tcp.flags.psh"), "tcp.flags.urg": ("bool", "tcp.flags.urg"), "tcp.flags.ece": ("bool", "tcp.flags.ece"), "tcp.flags.cwr": ("bool", "tcp.flags.cwr"),
    "udp.srcport": ("int", "udp.src_port"), "udp.dstport": ("int", "udp.dst_port"), "udp.length": ("int", "udp.length"), "udp.port": ("pair", "udp"),
    "icmp.type": ("int", "icmp.type"), "icmp.code": ("int", "icmp.code"), "arp.opcode": ("int", "arp.operation"), "arp.spa": ("addr", "arp.sender"), "arp.tpa": ("addr", "arp.target"), "eth.type": ("int", "eth.ether_type"),
    "dns.qname": ("str", "dns.query_name"), "dns.id": ("int", "dns.transaction_id"), "dns.opcode": ("int", "dns.opcode"), "dns.rcode": ("int", "dns.rcode"), "dns.qcount": ("int", "dns.question_count"), "dns.acount": ("int", "dns.answer_count"), "dns.qtype": ("int", "dns.query_type"), "dns.qr": ("bool", "dns.is_response"), "dns.answer": ("bool", "size(dns.answers) > 0"),
    "tls.sni": ("str", "tls_client_hello.sni"), "tls.handshake.type": ("int", "case when tls_client_hello is not null then 1 when tls_server_hello is not null then 2 end"), "tls.record_version": ("int", "coalesce(tls_client_hello.record_version, tls_server_hello.record_version)"), "tls.client_version": ("int", "tls_client_hello.client_version"), "tls.selected_version": ("int", "tls_server_hello.selected_version"), "tls.cipher_suite": ("int", "tls_server_hello.cipher_suite"),
    "http.method": ("str", "http.method"), "http.uri": ("str", "http.uri"), "http.host": ("str", "http.host"), "http.content_type": ("str", "http.content_type"), "http.status_code": ("int", "http.status_code"),
}
_COLUMNS = {*LAYERS, "orig_len", "cap_len", "src_ip", "dst_ip", "stream_id"}
COMPARISONS = {"==", "!=", ">", "<", ">=", "<="}
WORDS = {*PROTOCOLS, "and", "or", "not", "contains", "matches", "port", "src", "dst", "host", "true", "false"}


class FilterError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


@dataclass
class Token:
    kind: str  # op, word, name, int, v4, v6, cidr, str
    value: object
    at: int


_SCAN = re.compile(r"""(?P<space>[ \t\r\n]+)|(?P<op>==|!=|>=|<=|>|<|\(|\))|(?P<string>"(?:\\.|[^"\\])*")|(?P<plain>[A-Za-z0-9_][A-Za-z0-9_.:/]*)""", re.S)


def _literal(text: str, at: int) -> Token:
    try:
        if ":" in text:
            return Token("v6", ipaddress.IPv6Address(text), at)
        if "/" in text:
            address, prefix = text.split("/")
            if not re.fullmatch("[0-9]{1,3}", prefix) or int(prefix) > 32:
                raise ValueError
            return Token("cidr", (ipaddress.IPv4Address(address), int(prefix)), at)
        if "." in text:
            return Token("v4", ipaddress.IPv4Address(text), at)
        number = int(text[2:], 16) if text[:2].lower() == "0x" else int(text) if text.isdecimal() else -1
        if not 0 <= number < 1 << 64:
            raise ValueError
        return Token("int", number, at)
    except ValueError:
        raise FilterError(f"invalid value {text!r}", at) from None


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character {text[at]!r}", at)
        if m["op"]:
            out.append(Token("op", m["op"], at))
        elif m["string"]:
            body = re.sub(r'\\(["\\])', r"\1", m["string"][1:-1])
            out.append(Token("str", body.encode().decode("latin-1"), at))  # bytes count as characters
        elif m["plain"]:
            word = m["plain"]
            if word[0].isdigit() or (":" in word and re.fullmatch("[0-9A-Fa-f:./]+", word)):
                out.append(_literal(word, at))
            elif ":" in word or "/" in word:
                raise FilterError(f"unexpected text {word!r}", at)
            else:
                out.append(Token("word" if word in WORDS else "name", word, at))
        at = m.end()
    return out


_CLASS_OR_ESCAPE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\$|\(\?P<", re.S)


def java_pattern(pattern: str, at: int = 0) -> str:
    """A regular expression without lookaround and back-references in Spark's dialect: Unicode
    classes, `.` stops at \\n alone, `$` is the end of the text."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise FilterError("invalid regex: lookaround and back-references aren't supported", at)
    try:
        re.compile(pattern)
    except re.error as e:
        raise FilterError(f"invalid regex: {e}", at) from None
    return "(?Ud)" + _CLASS_OR_ESCAPE.sub(lambda m: {"$": r"\z", "(?P<": "(?<"}.get(m[0], m[0]), pattern)


# ---- conditions: a condition makes a Column for its plain or its negated form


@dataclass(frozen=True)
class Test:
    """A condition on one header column, as SQL."""

    column: str
    sql: str


class _Condition:
    """Makes a Column from its leaves, each of which goes through `share`. needs: tests that hold wherever the plain form does."""

    def __init__(self, make, needs=()):
        self.make, self.needs = make, frozenset(needs)

    def __call__(self, negated: bool, share) -> Column:
        return self.make(negated, share)


def _leaf(column: Column, *needs: Test):
    return _Condition(lambda negated, share: ~F.coalesce(share(column), F.lit(False)) if negated else share(column), needs)


def _never():
    return _Condition(lambda negated, share: F.lit(negated))


def _both(a, b, conjunction: bool):
    needs = a.needs | b.needs if conjunction else a.needs & b.needs
    return _Condition(lambda negated, share: a(negated, share) & b(negated, share) if conjunction != negated else a(negated, share) | b(negated, share), needs)


_LAYER = {"ip": "network = 2048", "ipv6": "network = 34525", "arp": "network = 2054", "tcp": "transport = 6", "udp": "transport = 17", "icmp": "transport in (1, 58)", "dns": "transport = 17", "tls": "transport = 6", "http": "transport = 6"}


def _of_layer(name: str) -> list[Test]:
    """The test for the layer that a protocol or field is of or in. Addresses are of either IP."""
    if name in ("ip.src", "ip.dst"):
        return [Test("network", "network in (2048, 34525)")]
    sql = _LAYER.get(name.split(".")[0])
    return [Test(sql.split()[0], sql)] if sql else []


def _of_value(name: str, op: str, value: Token) -> list[Test]:
    """The test for a field that must have a value."""
    if op != "==":
        return []
    if value.kind == "int" and value.value <= 65535 and name in ("tcp.srcport", "udp.srcport", "tcp.dstport", "udp.dstport"):
        column = f"{name[4:7]}_port"
        return [Test(column, f"{column} = {value.value}")]
    if value.kind == "int" and name in ("tcp.port", "udp.port"):
        return [Test("ports", f"contains(ports, ',{value.value},')")]
    if value.kind in ("v4", "v6") and name in ("ip.src", "ip.dst"):
        column = f"{name[3:]}_ip"
        return [Test(column, f"{column} = '{value.value}'")]
    return []


_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def _ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when(c.rlike(r"^[0-9.]+$"), sum((F.get(parts, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0)))


def _address_test(c: Column, op: str, value: Token) -> Column | None:
    if op not in ("==", "!="):
        return None
    if value.kind == "cidr":
        address, prefix = value.value
        size = 1 << (32 - prefix)
        low = int(address) // size * size
        inside = _ipv4_number(c).between(low, low + size - 1)  # null for v6: false either way
        return inside if op == "==" else ~inside
    if value.kind in ("v4", "v6"):
        return _OPS[op](c, F.lit(str(value.value)))
    return None


def _text_of(kind: str, expr: str) -> Column:
    if kind == "pair":
        return F.concat_ws(",", F.col(f"{expr}.src_port").cast("string"), F.col(f"{expr}.dst_port").cast("string"))
    return F.expr(expr).cast("string")


def _compare(name: str, op: str, value: Token):
    if name not in FIELDS:
        return _never()
    kind, expr = FIELDS[name]
    needs = _of_layer(name) + _of_value(name, op, value)
    present = F.col(expr).isNotNull() if kind == "pair" else F.lit(True)
    if op == "contains":
        return _leaf(present & F.contains(fold_ascii(_text_of(kind, expr)), fold_ascii(F.lit(value.value))), *needs)
    if op == "matches":
        return _leaf(present & _text_of(kind, expr).rlike(value.value), *needs)
    if kind == "int" and value.kind == "int":
        number = F.lit(value.value) if value.value < 1 << 63 else F.lit(str(value.value)).cast("decimal(20,0)")
        return _leaf(_OPS[op](F.expr(expr), number), *needs)
    if kind == "pair" and value.kind == "int":
        a, b = (_OPS[op](F.col(f"{expr}.{s}"), F.lit(value.value)) for s in ("src_port", "dst_port"))
        return _leaf(a & b if op == "!=" else a | b, *needs)
    if kind == "bool" and value.kind == "word" and op in ("==", "!="):
        return _leaf(_OPS[op](F.expr(expr), F.lit(value.value == "true")), *needs)
    if kind == "str" and value.kind == "str" and op in ("==", "!="):
        return _leaf(_OPS[op](F.expr(expr), F.lit(value.value)), *needs)
    if kind == "addr" and (test := _address_test(F.expr(expr), op, value)) is not None:
        return _leaf(test, *needs)
    return _never()


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth, self.end = tokens(text), 0, 0, len(text)
        self.unknown: list[str] = []

    def peek(self) -> Token:
        return self.tokens[self.at] if self.at < len(self.tokens) else Token("end", None, self.end)

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *values: str) -> bool:
        return self.peek().kind in ("word", "op") and self.peek().value in values

    def chain(self, word: str, part):
        out = part()
        while self.word(word):
            self.next()
            out = _both(out, part(), word == "and")
        return out

    def either(self):
        return self.chain("or", lambda: self.chain("and", self.negation))

    def deeper(self, inner):
        self.depth += 1
        if self.depth > DEPTH:
            raise FilterError("expression exceeds maximum nesting depth", self.peek().at)
        out = inner()
        self.depth -= 1
        return out

    def negation(self):
        if not self.word("not"):
            return self.atom()
        self.next()
        inner = self.deeper(self.negation)
        return _Condition(lambda negated, share: inner(not negated, share))

    def value(self, *kinds: str) -> Token:
        token = self.next()
        if token.kind not in kinds and not ("bool" in kinds and token.value in ("true", "false")):
            raise FilterError(f"expected a value, found {token.value!r}", token.at)
        return token

    def atom(self):
        token = self.next()
        if token.kind == "op" and token.value == "(":
            inner = self.deeper(self.either)
            if not self.word(")"):
                raise FilterError("expected closing ')'", self.peek().at)
            self.next()
            return inner
        if token.kind == "word" and token.value in PROTOCOLS:
            here = [F.col(c).isNotNull() for c in PROTOCOLS[token.value]]
            return _leaf(here[0] if len(here) == 1 else here[0] | here[1], *_of_layer(token.value))
        if token.kind == "word" and token.value == "port":
            number = self.value("int")
            if number.value > 65535:
                raise FilterError("port out of range", number.at)
            return _leaf((F.col("src_port") == number.value) | (F.col("dst_port") == number.value), Test("ports", f"contains(ports, ',{number.value},')"))
        if token.kind == "word" and token.value in ("src", "dst", "host"):
            address = self.value("v4", "v6", "cidr")
            tests = [_leaf(_address_test(F.col(c), "==", address)) for c in ("src_ip", "dst_ip") if token.value in ("host", c[:3])]
            if address.kind == "cidr":
                needs = [Test("network", "network in (2048, 34525)")]
            elif len(tests) == 2:
                needs = [Test("hosts", f"contains(hosts, ',{address.value},')")]
            else:
                needs = [Test(f"{token.value}_ip", f"{token.value}_ip = '{address.value}'")]
            found = tests[0] if len(tests) == 1 else _both(tests[0], tests[1], False)
            return _Condition(found.make, needs)
        if token.kind == "name":
            if token.value not in FIELDS:
                self.unknown.append(token.value)
            op = self.peek()
            if op.kind == "op" and op.value in COMPARISONS:
                self.next()
                return _compare(token.value, op.value, self.value("int", "v4", "v6", "cidr", "str", "bool"))
            if self.word("contains", "matches"):
                self.next()
                text = self.value("str")
                if op.value == "matches":
                    text = Token("str", java_pattern(text.value, op.at), text.at)
                return _compare(token.value, op.value, text)
            if token.value not in FIELDS:
                return _never()
            kind, expr = FIELDS[token.value]
            return _leaf(F.expr(expr) if kind == "bool" else F.col(expr).isNotNull() if kind == "pair" else F.expr(expr).isNotNull(), *_of_layer(token.value))
        raise FilterError("unexpected end of expression" if token.kind == "end" else f"unexpected token {token.value!r}", token.at)


def _parsed(text: str):
    if not text.strip():
        raise FilterError("empty expression", 0)
    parser = _Parser(text)
    condition = parser.either()
    if parser.peek().kind != "end":
        raise FilterError(f"unexpected token {parser.peek().value!r}", parser.peek().at)
    return condition, parser.unknown


def display_filter(text: str, share=lambda leaf: leaf) -> Column:
    """The filter as a Column over packets (with stream_id if it names a stream). share: puts another Column in the place
    of each of its conditions."""
    return _parsed(text)[0](False, share)


def necessary(text: str) -> list[Test]:
    """Tests of header columns that every packet passes that the filter finds."""
    return sorted(_parsed(text)[0].needs, key=lambda t: t.sql)


def filter_columns(text: str) -> set[str]:
    """The columns of packets that the filter reads."""
    out: set[str] = set()
    for t in tokens(text):
        if t.value in PROTOCOLS and t.kind == "word":
            out.update(PROTOCOLS[t.value])
        elif t.kind == "word":
            out.update({"port": ("src_port", "dst_port"), "src": ("src_ip",), "dst": ("dst_ip",), "host": ("src_ip", "dst_ip")}.get(t.value, ()))
        elif t.kind == "name" and t.value in FIELDS:
            out.update(m for m in re.findall(r"(?<![\w.])[a-z]\w*", FIELDS[t.value][1]) if m in _COLUMNS)
    return out


def unknown_fields(text: str) -> list[str]:
    """Names in the filter that are no fields, in order; they never match."""
    return _parsed(text)[1]
