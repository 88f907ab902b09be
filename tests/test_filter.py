import pytest

from packloom.operators.dissect import dissect
from packloom.operators.streams import with_packet_index, with_stream_id
from packloom.plans.display_filter import DEPTH, FIELDS, FilterError, display_filter, unknown_fields
from wire import frames, ipv4, ipv6, tcp, udp


@pytest.fixture(scope="module")
def tracked(spark):
    data = [ipv4(6, tcp(51514, 443)), ipv4(17, udp(5353, 53, b"x")), ipv6(6, tcp(1, 2)), ipv4(6, tcp(443, 51514, b"GET /x HTTP/1.1\r\nHost: \xc3\x89.b\r\n\r\n", flags=18), src=(198, 51, 100, 20), dst=(192, 0, 2, 10))]
    return with_stream_id(dissect(with_packet_index(frames(spark, *data)))).cache()


CASES = {
    "tcp": [0, 2, 3], "not tcp": [1], "tcp and not ipv6": [0, 3], "udp or ipv6": [1, 2], "udp or ipv6 and tcp": [1, 2], "(udp or ipv6) and tcp": [2], "port 443": [0, 3], "src 192.0.2.10": [0, 1],
    "host 192.0.2.0/24": [0, 1, 3], "dst 2001:db8::2": [2], "ip.src != 2001:db8::1": [0, 1, 3], "ip.src == 0.0.0.0/0": [0, 1, 3], "not ip.src == 192.0.2.0/24": [2, 3],
    "tcp.port != 443": [2], "not tcp.port == 443": [1, 2], "tcp.flags.ack": [3], "tcp.flags.ack == false": [0, 2], "ip.ttl": [0, 1, 3], "ip.ttl == 64": [0, 1, 3], "ip.ttl >= 0x41": [], "not ip.ttl > 5": [2],
    'http.host contains "?"': [3], 'http.uri matches "^/X$"': [], 'http.uri matches "(?i)^/X$"': [3], 'tcp.port contains "4,4"': [0], 'tcp.port matches "^443,"': [3], "tcp.stream == 0": [0, 3], "udp.stream >= 0": [1],
    'ip.ttl == "64"': [], "nosuch == 1": [], "not nosuch": [0, 1, 2, 3], "frame.len > 18446744073709551615": [], "ip.proto <= 6": [0, 3], "eth and not not udp": [1],
}


@pytest.mark.parametrize("text", CASES)
def test_matches(tracked, text):
    assert [r[0] for r in tracked.filter(display_filter(text)).orderBy("frame_no").select("frame_no").collect()] == CASES[text]


@pytest.mark.parametrize("text", ["", "  ", "tcp and", "tcp tcp", "(tcp", "!tcp", "a = 1", "port 70000", "ip.src == 1.2.3.4/33", "src 10", 'x matches "("', 'x matches "(?=a)"', 'x contains 5', "::1", "tcp && udp", 'x == "a', "not " * (DEPTH + 1) + "tcp"])
def test_errors(spark, text):
    with pytest.raises(FilterError):
        display_filter(text)


def test_deep_nesting_and_lint(spark):
    display_filter("(" * DEPTH + "tcp" + ")" * DEPTH)
    assert len(FIELDS) == 64
    assert unknown_fields("tcp.prot == 1 or ip.ttl == 2 and tcp.prot") == ["tcp.prot", "tcp.prot"]


def test_every_field_compiles(tracked):
    ops = {"int": "{} == 1", "bool": "{}", "str": '{} == "a"', "addr": "{} == 1.2.3.4", "pair": "{} == 1"}
    text = " or ".join(ops[kind].format(name) for name, (kind, _) in FIELDS.items())
    assert tracked.filter(display_filter(text)).count() == 4
