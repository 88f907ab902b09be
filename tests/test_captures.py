"""Capture files: splits by byte ranges, damage, pcapng sections, filters in the scan."""

import io
import random
import pickle
import struct

import pytest

from packloom.operators.dissect import dissect
from packloom.plans.display_filter import display_filter
from packloom.sources import formats, pcap
from wire import frames, ipv4, tcp, udp


def record(data, seconds=1, order="<", fraction=5, original=None):
    return struct.pack(order + "4I", seconds, fraction, len(data), original or len(data)) + data


def head(order="<", magic=0xA1B2C3D4, snap=65535, link=1):
    return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, link)


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(order="<", link=1, resolution=None):
    options = b"" if resolution is None else struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0)
    return block(1, struct.pack(order + "HHI", link, 0, 0) + options, order)


def packet(data, which=0, ticks=7, order="<"):
    return block(6, struct.pack(order + "5I", which, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data, order)


def whole(content):
    """Frames and damage of a walk from the file's start."""
    return list(formats.walk(io.BytesIO(content), "f").run(1 << 62))


def numbered(rows):
    """(time, size, original size, data, error) of rows whose numbers are right."""
    assert [r["frame_no"] for r in rows] == list(range(len(rows)))
    packets = [r["packet_index"] for r in rows if r["packet_index"] is not None]
    assert packets == list(range(len(packets)))
    return [(r["ts_ns"], r["cap_len"], r["orig_len"], None if r["data"] is None else bytes(r["data"]), r["error"]) for r in rows]


def in_ranges(spark, path, split_bytes):
    """A scan by Spark in a few ranges; by the same code without Spark in any number of them."""
    size = path.stat().st_size
    if size < 20 * split_bytes:
        return numbered([r.asDict() for r in pcap.scan_capture(spark, str(path), "PERMISSIVE", split_bytes).orderBy("frame_no").collect()])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pcap, "_looked", lambda _, ranges: [r.look() for r in ranges])
        splits = pcap._splits(None, [(str(path), size)], split_bytes)
    assert len(splits) == -(-size // split_bytes)
    return numbered([r for s in splits for b in pcap._Batches([], [], False).of(s) for r in b.to_pylist()])


def expected(content):
    return [(None, None, None, None, f"{x.message} at byte {x.offset}") if isinstance(x, formats.Damage) else (x.ts_ns, x.size, x.original, x.data, None) for x in whole(content)]


def hostile_payloads(rng, order, kind):
    """Payloads that hold captures, chains of records, zeros, or noise."""
    fake = record(bytes(rng.randrange(256) for _ in range(30)), order=order)
    inner = section(order) + interface(order) + packet(b"inner" * 9, order=order) * 25
    return [b"", b"\0" * 200, fake * 40, (fake * 20)[:-7], rng.randbytes(rng.randrange(300)), struct.pack(order + "4I", 1, 2, 40, 40) * 30, head(order) + fake * 30, inner, inner[4:-3]]


@pytest.mark.parametrize("order, magic", [("<", 0xA1B2C3D4), (">", 0xA1B23C4D)])
def test_pcap_in_ranges(spark, tmp_path, order, magic):
    rng = random.Random(order)
    content = head(order, magic) + b"".join(record(rng.choice(hostile_payloads(rng, order, "pcap")), rng.randrange(1 << 31), order, rng.randrange(10**6)) for _ in range(150))
    path = tmp_path / "a.pcap"
    path.write_bytes(content)
    want = expected(content)
    assert len(want) == 150 and all(x[4] is None for x in want)
    for split in (97, 1000, len(content) // 7):
        assert in_ranges(spark, path, split) == want
    assert pcap.read_capture(spark, str(path), split_bytes=len(content) // 5 + 1).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("seed", range(3))
def test_pcap_damage_in_the_middle(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts = [record(rng.randbytes(rng.randrange(20, 90)), 9) for _ in range(120)]
    bad = (20, 55, 90)
    for i in bad:
        parts[i] = [struct.pack("<4I", 1, 2, 1 << 30, 1 << 30) + rng.randbytes(300), rng.randbytes(700), parts[i][:-5] + b"\xff" * 400][seed]
    content = head() + b"".join(parts) + (b"\1" * 9 if seed else b"")
    path = tmp_path / "a.pcap"
    path.write_bytes(content)
    want = expected(content)
    sound = {x[3] for x in want if x[4] is None}
    assert any(x[4] for x in want) and all(p[16:] in sound for i, p in enumerate(parts) if i not in bad and i - 1 not in bad)
    for split in (64, 300, 3000):
        assert in_ranges(spark, path, split) == want
    errors = pcap.capture_errors(spark, str(path), 3000).collect()
    assert sorted(r.frame_no for r in errors) == [i for i, x in enumerate(want) if x[4]]
    with pytest.raises(Exception, match="record"):
        pcap.read_capture(spark, str(path), split_bytes=3000).count()


def test_pcapng_in_ranges(spark, tmp_path):
    rng = random.Random(5)
    content, want = b"", []
    for k in range(6):
        order = "<>"[k % 2]
        content += section(order) + interface(order, resolution=9)
        resolutions = [9]
        for i in range(40):
            if rng.random() < 0.15:
                resolutions.append(rng.choice([3, 6, 0x80 | 10]))
                content += interface(order, resolution=resolutions[-1])
            data, which, ticks = rng.choice(hostile_payloads(rng, order, "pcapng")), rng.randrange(len(resolutions)), rng.randrange(1 << 40)
            if i % 7 == 3:
                content += block(3, struct.pack(order + "I", len(data)) + data, order)
                want.append((None, data))
            else:
                content += packet(data, which, ticks, order) + (block(0xBAD, b"comment", order) if i % 5 == 0 else b"")
                want.append((ticks * 10**9 // formats.ticks(resolutions[which]), data))
    path = tmp_path / "a.pcapng"
    path.write_bytes(content)
    for split in (200, 3000, len(content) // 6):
        got = in_ranges(spark, path, split)
        assert [(t, d) for t, _, _, d, _ in got] == want and not any(e for *_, e in got)
    assert pcap.read_capture(spark, str(path), split_bytes=len(content) // 3 + 1).rdd.getNumPartitions() == 3


def test_pcapng_damage_and_refusals(spark, tmp_path):
    parts = [section(), interface(), *[packet(bytes([i]) * 40) for i in range(30)]]
    parts[12] = b"\xee" * 64
    path = tmp_path / "a.pcapng"
    path.write_bytes(b"".join(parts))
    want = expected(b"".join(parts))
    assert sum(1 for x in want if x[4]) == 1 and sum(1 for x in want if x[3]) == 29
    for split in (40, 100, 700):
        assert in_ranges(spark, path, split) == want
    for refused, said in (([interface(), *parts[2:20], interface(link=101), *parts[2:20]], "link type 101"), ([*parts[2:11], *parts[2:11]], "unknown interface"), ([interface(), *parts[2:9], *[packet(b"x" * 30, 1)] * 9], "unknown interface")):
        path.write_bytes(section() + b"".join(refused))
        for split in (500, 1 << 20):
            with pytest.raises(Exception, match=said):
                pcap.read_capture(spark, str(path), split_bytes=split).filter("frame_no < 3").count()


def test_search_is_linear():
    """Zeros, and records that all look plausible but lead nowhere."""
    import time

    for filler in (b"\0" * 2_000_000, struct.pack("<4I", 1, 2, 16, 16) * 60_000, struct.pack("<4I", 1, 2, 4000, 4000) * 60_000):
        content = head() + record(b"a" * 50) + struct.pack("<4I", 0, 0, 1 << 31, 1 << 31) + filler + b"\xff" * 70_000
        began = time.time()
        whole(content)
        assert time.time() - began < 20


def test_filters_in_the_scan(spark, tmp_path, capsys):
    data = [ipv4(6, tcp(1000 + i, 443 if i % 3 else 80)) for i in range(60)] + [ipv4(17, udp(53, 5000 + i)) for i in range(20)] + [b"short", b"\xff" * 12 + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x800, 6, 4, 1) + b"\1" * 20]
    pcap.write_pcaps(frames(spark, *data).coalesce(1), str(tmp_path))
    from packloom.plans.scan import read_packets, scan_filter

    path = f"{tmp_path}/*.pcap"
    every = dissect(pcap.read_capture(spark, path).filter("packet_index is not null"))
    for text in ("tcp and port 443", "udp", "arp", "ip.src == 192.0.2.10 and tcp.dstport == 80", "host 198.51.100.20 and not tcp", "tcp or udp", "dns", "frame.len > 10 and tcp.srcport > 1050", "not ip", "udp.port == 5003", "ip.proto == 17"):
        got = read_packets(spark, path, text, split_bytes=700, columns=["frame_no", "protocol"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.filter(display_filter(text)).select("frame_no", "protocol").collect())), text
    needs, header = scan_filter("tcp and port 443")
    scanned = pcap.scan_capture(spark, path, header=header).filter(needs)
    scanned.explain("formatted")
    plan = capsys.readouterr().out
    assert "Filter" not in plan.replace("PushedFilters", "").split("BatchScan")[0], plan
    assert scanned.count() == 40
    assert scan_filter("tcp or udp")[1] == [] and scan_filter("not (tcp and udp)")[1] == []


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(pcap.CaptureSource)
    bad = frames(spark, *(ipv4(6, tcp(i, 2)) for i in range(1, 30))).selectExpr("if(frame_no = 20, raise_error('stop'), ts_ns) as ts_ns", "data", "orig_len").repartition(4)
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="stop"):
        bad.write.format("capture").mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_tasks_read_runs_of_splits():
    """Short ranges don't make a task each, and a task doesn't get the splits of all."""
    splits = [pcap.Split("x", 100 * i, 100 * i + 100, 100 * i) for i in range(10_000)]
    runs = pcap.grouped(splits, 2)
    assert [s for r in runs for s in r.splits] == splits and len(runs) == 8
    source = pcap.CaptureSource({"path": "x", "splits": "y" * 10**6})
    assert len(pickle.dumps(source)) > 10**6  # on its way to the planner
    reader = source.reader(None)
    assert reader.options["splits"] and len(pickle.dumps(reader)) < 1000 and len(pickle.dumps(source)) < 1000
