"""HTTP messages over segments, whole and in stretches."""

import random

import pytest

from packloom.operators import http_messages
from packloom.operators.http_messages import Parser
from packloom.storage import Stored


def message(rng, answer):
    body = rng.randbytes(rng.choice((0, 1, 40, 700))).replace(b"HTTP", b"http")
    if rng.random() < 0.2:
        body = b"GET /trap HTTP/1.1\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n" + body
    first = b"HTTP/1.1 200 OK\r\n" if answer else b"POST /%d HTTP/1.1\r\n" % rng.randrange(99)
    kind = rng.randrange(3 if not answer or body else 2)
    if kind == 0:
        return first + b"Content-Length: %d\r\n\r\n" % len(body) + body, len(body)
    if kind == 1:
        cuts = [body[i : i + 60] for i in range(0, len(body), 60)]
        return first + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x;x=y\r\n%s\r\n" % (len(c), c) for c in cuts) + b"0\r\n" + b"T: v\r\n" * rng.randrange(2) + b"\r\n", len(body)
    return (b"HTTP/1.1 304 Not Modified\r\nContent-Length: 9\r\n\r\n" if answer else b"GET / HTTP/1.0\r\nHost: h\r\n\r\n"), 0


def stream(rng, n, answer, start):
    data, want = b"", []
    for _ in range(n):
        said, size = message(rng, answer)
        want.append((start + len(data), size))
        data += said
    return data, want


def pieces(rng, data, start, most=200):
    at = 0
    while at < len(data):
        n = rng.randrange(1, most)
        yield start + at, data[at : at + n]
        at += n


@pytest.mark.parametrize("seed", range(20))
def test_parser(seed):
    rng = random.Random(seed)
    data, want = stream(rng, 12, seed % 2, 1000)
    parser = Parser()
    got = [m for s, d in pieces(rng, data, 1000, 3 if seed < 5 else 300) for m in parser.feed(s, d)] + list(parser.end())
    assert [(m["seq"], m["body_len"]) for m in got] == want and all(m["complete"] for m in got)
    # A state that is stored and read again goes on.
    import json

    got, state = [], None
    for s, d in pieces(rng, data, 1000):
        parser = Parser(json.loads(state) if state else None)
        got += parser.feed(s, d)
        state = json.dumps(parser.state())
    assert [(m["seq"], m["body_len"]) for m in got] == want


def test_loss_and_ends():
    parser = Parser()
    got = list(parser.feed(0, b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\nabc"))
    got += parser.feed(90, b"xyz HTTP/1.1 200 OK\r\n\r\nto the end")
    got += parser.end()
    assert [(m["seq"], m["body_len"], m["complete"]) for m in got] == [(0, 50, False), (94, 10, True)]
    assert not list(Parser().feed(0, b"\x16\x03\x01" * 9000))


def test_messages_in_stretches(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(6):
        answer = i % 2
        data, found = stream(rng, 25, answer, 5000 * i)
        if i == 5:  # a body that goes over many stretches, and one more message behind it
            big = b"HTTP/1.1 200 OK\r\nContent-Length: 9000\r\n\r\n" + b"HTTP/1.1 200 OK\r\n\r\n" * 450 + b"z" * 450
            found, data = [(s + len(big), n) for s, n in found], big + data
            found.insert(0, (5000 * i, 9000))
        way = ("c", bytes([i]), "hi_to_lo" if answer else "lo_to_hi")
        rows += [(*way, s, d) for s, d in pieces(rng, data, 5000 * i)]
        want += [(way[1], s, n) for s, n in found]
    rng.shuffle(rows)
    segments = spark.createDataFrame(rows, "capture string, stream_key binary, direction string, seq bigint, data binary")
    for stretch in (700, 1 << 20):
        got = http_messages.http_messages(segments, stretch).collect()
        assert sorted((bytes(m.stream_key), m.seq, m.body_len) for m in got) == sorted(want) and all(m.complete for m in got)
    assert http_messages.http_messages(segments.limit(0)).count() == 0


CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"


@pytest.mark.parametrize(
    "data, most",
    [
        # Most borders of stretches are inside of heads.
        ((b"GET /" + b"a" * 40 + b" HTTP/1.1\r\nHost: h\r\n\r\n" + b"POST / HTTP/1.1\r\nContent-Length: 9\r\n\r\n123456789") * 150, 2),
        # Chunks without a start, and with one in each stretch that isn't: a round for each doubling of the stretches parsed.
        (CHUNKED + b"5\r\nabcde\r\n" * 2500 + b"0\r\n\r\n" + CHUNKED + b"0\r\n\r\n", 2),
        (CHUNKED + (b"28\r\n" + b"HTTP/1.1 200 OK\r\nContent-Length: 500\r\n\r\n" + b"\r\n") * 500 + b"0\r\n\r\n" + CHUNKED + b"0\r\n\r\n", 8),
        # No HTTP at all.
        (b"\x16\x03\x01 \n" * 4000, 2),
    ],
    ids=["heads", "chunks", "traps", "none"],
)
def test_many_stretches_take_few_rounds(spark, monkeypatch, data, most):
    put, stored = Stored.put, []
    monkeypatch.setattr(Stored, "put", lambda self, df: stored.append(put(self, df)) or stored[-1])
    parser = Parser()
    cut = list(pieces(random.Random(5), data, 0))
    want = [m for s, d in cut for m in parser.feed(s, d)] + list(parser.end())
    segments = spark.createDataFrame([("c", b"k", "lo_to_hi", s, d) for s, d in cut], "capture string, stream_key binary, direction string, seq bigint, data binary")
    got = http_messages.http_messages(segments, 512)
    assert len(stored) <= most  # a table for the stretches and one for each round
    assert sorted((m.seq, m.head_len, m.body_len, m.complete) for m in got.collect()) == [(m["seq"], m["head_len"], m["body_len"], m["complete"]) for m in want]


@pytest.mark.parametrize("seed", range(6))
def test_stretches_of_anything(spark, seed):
    """Lost bytes, starts in bodies, bodies far beyond what is carried, and what is no HTTP: as one parser has it that reads all."""
    rng = random.Random(seed)
    rows, want = [], []
    for i in range(4):
        data = b""
        for _ in range(12):
            data += rng.choice((stream(rng, 3, i % 2, 0)[0], rng.randbytes(rng.choice((20, 30000))), b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % rng.choice((10**19, 70000)) + b"z" * 70000, CHUNKED + b"9000\r\n" + b"y" * 0x9000 + b"\r\n0\r\n\r\n", b"GET /" + b"u" * 4090))
        cut = [p for p in pieces(rng, data, 5000 * i, 1460) if rng.random() > 0.001]
        parser = Parser()
        want += [(bytes([i]), m["seq"], m["body_len"], m["complete"]) for m in [*(m for s, d in cut for m in parser.feed(s, d)), *parser.end()]]
        rows += [("c", bytes([i]), "lo_to_hi", s, d) for s, d in cut]
    segments = spark.createDataFrame(rows, "capture string, stream_key binary, direction string, seq bigint, data binary")
    for stretch in (3000, 60000):
        got = http_messages.http_messages(segments, stretch).collect()
        assert sorted((bytes(m.stream_key), m.seq, m.body_len, m.complete) for m in got) == sorted(want)
