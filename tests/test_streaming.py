"""Running conversations with state, and captures that grow."""

import random

import pytest
from pyspark.sql import functions as F

from packloom.operators import streams
from packloom.operators.dissect import dissect
from packloom.sources import formats, pcap
from packloom.streaming import growing
from packloom.streaming.conversations import running_conversations
from packloom.streaming.growing import advanced, stream_frames
from test_captures import head, interface, packet, record, section
from wire import frames, ipv4, tcp, udp


def run(query, checkpoint, sink):
    """Runs a streaming query over what there is; all rows of its sink, with the batch of each."""

    def put(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(sink)

    q = query.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_conversations_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    a, b = (192, 0, 2, 10), (198, 51, 100, 20)
    data = [ipv4(6, tcp(9, 80, flags=2)), ipv4(6, tcp(80, 9, flags=18), src=b, dst=a), *[ipv4(17, udp(5, 53)) for _ in range(9)], *[ipv4(6, tcp(rng.randrange(1, 4), 80, flags=rng.choice((16, 4, 17)))) for _ in range(60)], b"\xff" * 30]
    packets = dissect(streams.with_packet_index(frames(spark, *data)), streams.STREAM_COLUMNS)
    untimed = packets.withColumn("ts_ns", F.when(F.col("packet_index") % 11 != 0, F.col("ts_ns"))).coalesce(1)
    want = sorted(tuple(r) for r in streams.streams(untimed).select("first_index", "packet_count", "byte_count", "first_seen_ns", "last_seen_ns", "tcp_flags_seen", "syn_ack_seen", "rst_count").collect())
    for seed in (1, 2):
        files = str(tmp_path / f"in{seed}")
        untimed.repartition(4, F.xxhash64("packet_index", F.lit(seed))).sortWithinPartitions(F.desc("packet_index")).write.parquet(files)
        stream = spark.readStream.schema(untimed.schema).option("maxFilesPerTrigger", 2).parquet(files)
        run(running_conversations(stream), str(tmp_path / f"c{seed}"), str(tmp_path / f"out{seed}"))
        rows = spark.read.parquet(str(tmp_path / f"out{seed}"))
        last = rows.groupBy("capture", "stream_key").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*")
        assert rows.agg(F.max("batch")).first()[0] > 0 and rows.filter("closed").count() == 0
        assert sorted(tuple(r) for r in last.select("first_index", "packet_count", "byte_count", "first_seen_ns", "last_seen_ns", "tcp_flags_seen", "syn_ack_seen", "rst_count").collect()) == want


def test_conversations_without_end_call_no_python(spark, tmp_path):
    """A call for each conversation of a batch takes longer than a batch may."""
    packets = dissect(streams.with_packet_index(frames(spark, ipv4(6, tcp(9, 80)))), streams.STREAM_COLUMNS)
    packets.write.parquet(str(tmp_path / "in"))
    query = running_conversations(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")))
    plan = query._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan and "TransformWithState" not in plan


def test_idle_conversations_end(spark, tmp_path):
    data = [ipv4(6, tcp(1, 80)), ipv4(6, tcp(1, 80)), ipv4(6, tcp(2, 80)), ipv4(6, tcp(1, 80))]
    times = [1_000, 1_005, 6_000, 10_000]
    packets = dissect(streams.with_packet_index(frames(spark, *data)), streams.STREAM_COLUMNS)
    packets = packets.withColumn("ts_ns", F.element_at(F.array(*[F.lit(t * 10**9) for t in times]), (F.col("packet_index") + 1).cast("int")))
    files, stored = tmp_path / "in", packets.collect()
    for i, r in enumerate(stored):
        spark.createDataFrame([r], packets.schema).coalesce(1).write.mode("append").parquet(str(files))
        stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(files))
        run(running_conversations(stream, idle="10 minutes"), str(tmp_path / "c"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).filter("not closed or packet_count > 0").collect()
    closed = [(r.packet_count, r.first_seen_ns, r.last_seen_ns) for r in rows if r.closed]
    assert (2, 1_000 * 10**9, 1_005 * 10**9) in closed
    assert (1, 10_000 * 10**9, 10_000 * 10**9) in [(r.packet_count, r.first_seen_ns, r.last_seen_ns) for r in rows if not r.closed]  # another one of the same ends


def test_growing_captures(spark, tmp_path):
    rng = random.Random(9)
    payloads = [rng.randbytes(rng.randrange(14, 90)) for _ in range(60)]
    whole = {"a.pcap": head() + b"".join(record(p) for p in payloads), "b.pcapng": b"".join(section() + interface(resolution=9) + interface(resolution=6) + b"".join(packet(p, i % 2) for i, p in enumerate(payloads[k : k + 20])) for k in (0, 20, 40))}
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    for share in (0.0, 0.2, 0.21, 0.6, 1.0):
        for name, content in whole.items():
            (files / name).write_bytes(content[: int(len(content) * share)])
        query = stream_frames(spark, f"{files}/*", split_bytes=500).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    rows = spark.read.parquet(out).orderBy("capture", "frame_no").collect()
    for name in whole:
        mine = [r for r in rows if r.capture.endswith(name)]
        assert [r.frame_no for r in mine] == list(range(60)) and [bytes(r.data) for r in mine] == payloads and [r.packet_index for r in mine] == list(range(60))
    assert [(r.ts_ns) for r in rows if r.capture.endswith("b.pcapng")][:2] == [7, 7000]


def test_half_written_records_wait(tmp_path):
    content = head() + b"".join(record(bytes([i]) * 30) for i in range(10))
    path = tmp_path / "a.pcap"
    seen = set()
    for n in range(len(content) + 1):
        path.write_bytes(content[:n])
        marks = advanced(str(path), None)
        whole = max(0, n - 24) // 46
        assert (marks[-1][:2] if marks else [24, 0]) == [24 + 46 * whole, whole]
        seen.add(whole)
    assert seen == set(range(11))
    damaged = content[: 24 + 46 * 3] + b"\xff" * 46 + content[24 + 46 * 4 :]
    path.write_bytes(damaged)
    assert advanced(str(path), None)[-1][:3] == [len(content), 10, 9]
    with pytest.raises(formats.CaptureError):
        path.write_bytes(head(link=101) + content[24:])
        advanced(str(path), None)


def test_a_trigger_walks_once(tmp_path, monkeypatch):
    path = tmp_path / "a.pcap"
    path.write_bytes(head() + b"".join(record(bytes([i]) * 30) for i in range(100)))
    walks = []
    monkeypatch.setattr(growing, "advanced", lambda *a: walks.append(a) or advanced(*a))
    reader = growing.GrowingReader({"path": str(path), "splitBytes": "460"})
    end = reader.latestOffset()
    runs = reader.partitions({}, end)
    assert len(walks) == 1 and len(runs) <= 5 and sum(len(r.splits) for r in runs) == 10
    restarted = growing.GrowingReader({"path": str(path), "splitBytes": "460"})
    assert restarted.partitions({}, end) == runs and len(walks) == 2
