"""pcap and pcapng files as DataFrames, and a pcap sink.

The data source "capture" reads files in splits of byte ranges:

    read_capture(spark, "/captures/*.pcap")

A task for each range of a large file guesses where its first record starts, and walks the range's record headers.
A guess holds if it is where the walk over the range before ends; other ranges are walked again from there,
so the splits are those of a walk from the file's start, whatever the payloads hold. Sums over the
ranges give the numbers of each one's first frame and packet, and in pcapng files its byte order and interfaces. The
driver gets a row for each range, of at most MOST_SPLITS: ranges grow with the bytes there are. Then each
split is a task that reads its own range alone.

Filters on header columns (dissect.HEADER) are pushed into the scan: a batch's headers are decoded,
and only frames that pass become rows.

Paths are local to, or mounted by, all executors; read_small_captures() goes through Spark's file systems
instead.
"""

from __future__ import annotations

import base64
import glob
import io
import os
import pickle
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage

from ..operators.dissect import HEADER, decoded
from .formats import ETHERNET, ETHERNET_HEADER, CaptureError, Damage, PcapngWalk, PcapWalk, sniff, walk

#: packet_index numbers the frames that have an Ethernet header, and is null for others.
SCHEMA = "capture string, frame_no bigint, packet_index bigint, ts_ns bigint, cap_len int, orig_len bigint, data binary"
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Ranges of this many bytes, or more so that there are at most so many; frames and bytes in one Arrow batch.
SPLIT_BYTES, MOST_SPLITS, BATCH, BATCH_BYTES = 64 << 20, 100_000, 4096, 16 << 20
#: A task reads consecutive splits of up to this many bytes, if there are tasks enough for the cores without them.
TASK_BYTES = 16 << 20


@dataclass
class Split(InputPartition):
    """The records of a file that start in [start, past): numbers of the first frame and packet, and the state of a pcapng
    file there. A start of None: the next record is searched for from `low` on."""

    path: str
    start: int | None = 0
    past: int = 1 << 62
    low: int = 0
    first: int = 0
    first_packet: int = 0
    order: str = "<"
    interfaces: list[int] = field(default_factory=list)

    def walk(self, f):
        f.seek(0)
        kind = sniff(f.read(4))
        if self.low == 0:
            found = walk(f, self.path)
            if kind == "pcapng" and self.past == 1 << 62:  # a file in one split is checked here, before its packets are read
                for _ in found.run(self.past, data=False):
                    pass
                found = walk(f, self.path)
            return found
        found = PcapWalk(f, self.path, self.start) if kind == "pcap" else PcapngWalk(f, self.path, self.start, self.order, self.interfaces)
        if self.start is None:
            found.at = found.sound(self.low, self.past)
        return found


@dataclass
class Splits(InputPartition):
    """Splits that one task reads one after the other."""

    splits: list[Split]


def grouped(splits: list[Split], cores: int) -> list[Splits]:
    """The splits in runs of up to TASK_BYTES, or fewer bytes so that there are four tasks for each core."""
    sizes = [s.past - s.low if s.past < 1 << 62 else os.path.getsize(s.path) for s in splits]
    most = min(TASK_BYTES, sum(sizes) // max(4 * cores, 1))
    out, held = [], 0
    for split, size in zip(splits, sizes, strict=True):
        if not out or held + size > most:
            out.append(Splits([]))
            held = 0
        out[-1].splits.append(split)
        held += size
    return out


# ---- splits of large files


@dataclass
class Range:
    """What a walk over the records that start in [low, high) found. A start or end of None is a search that goes on
    into the next range."""

    path: str
    low: int
    high: int
    searched: bool = True
    start: int | None = None
    order: str = "<"
    end: int | None = None
    order_at_end: str = "<"
    frames: int = 0
    packets: int = 0
    sections: int = 0
    interfaces: list[int] = field(default_factory=list)
    need: int = 0

    def look(self) -> Range:
        with open(self.path, "rb") as f:
            kind = sniff(f.read(4))
            if self.low == 0:
                found = walk(f, self.path)
            else:
                found = PcapWalk(f, self.path, self.start) if kind == "pcap" else PcapngWalk(f, self.path, self.start, self.order)
                if self.searched:
                    found.at = found.sound(self.low, self.high)
            self.start, self.order, self.frames, self.packets = found.at, found.order_now, 0, 0
            for x in found.run(self.high, data=False):
                self.frames += 1
                self.packets += not isinstance(x, Damage) and x.size >= ETHERNET_HEADER
            self.end, self.order_at_end, self.sections, self.interfaces, self.need = found.at, found.order_now, found.sections, found.interfaces, found.need
        return self

    def follows(self, before: Range) -> bool:
        """Whether this is the walk that goes on where the one before it ended."""
        if before.end is None:
            return self.searched
        return self.start == before.end and (before.end >= self.high or self.order == before.order_at_end)


def _looked(spark: SparkSession, ranges: list[Range]) -> list[Range]:
    """The ranges after a task has looked at each."""

    def look(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"at": b["at"], "range": [pickle.dumps(pickle.loads(r).look()) for r in b["range"]]})

    rows = spark.createDataFrame([(i, pickle.dumps(r)) for i, r in enumerate(ranges)], "at int, range binary").repartitionByRange(min(len(ranges), 4 * spark.sparkContext.defaultParallelism), "at")
    return [pickle.loads(r.range) for r in sorted(rows.mapInPandas(look, "at int, range binary").collect())]  # at most MOST_SPLITS


def _splits(spark: SparkSession, sizes: list[tuple[str, int]], split_bytes: int) -> list[Split]:
    split_bytes = max(split_bytes, -(-sum(n for _, n in sizes) // MOST_SPLITS))
    cut = {p: range(0, n, split_bytes) for p, n in sizes if n > split_bytes}
    ranges = _looked(spark, [Range(p, low, min(low + split_bytes, n)) for p, n in sizes for low in cut.get(p, ())]) if cut else []
    while True:
        wrong = [k for k in range(1, len(ranges)) if ranges[k].low and not ranges[k].follows(ranges[k - 1])]
        wrong = [k for k in wrong if k - 1 not in set(wrong)] if len(wrong) > 1 else wrong  # the end of one that is wrong says nothing
        if not wrong:
            break
        for k in wrong:
            before = ranges[k - 1]
            ranges[k].searched, ranges[k].start, ranges[k].order = before.end is None, before.end, before.order_at_end
        for k, r in zip(wrong, _looked(spark, [ranges[k] for k in wrong]), strict=True):
            ranges[k] = r
    out = [Split(p) for p, _ in sizes if p not in cut]
    first = packets = 0
    interfaces: list[int] = []
    for r in ranges:
        if r.low == 0:
            first, packets, interfaces = 0, 0, []
        if r.need > len(interfaces):
            raise CaptureError(f"{r.path}: packet of an unknown interface")
        out.append(Split(r.path, r.start, r.high, r.low, first, packets, r.order, interfaces))
        first, packets, interfaces = first + r.frames, packets + r.packets, r.interfaces if r.sections or r.low == 0 else interfaces + r.interfaces
    return out


# ---- the data source


class _Batches:
    """Record batches of frames, with header columns, cut down to those that pass the filters."""

    def __init__(self, header: list[str], filters: list[tuple], strict: bool):
        self.header, self.filters, self.strict = header, filters, strict
        self.schema = pa.schema([(k, _ARROW[v]) for k, v in (x.split() for x in schema_of(header).split(", "))])

    def of(self, split: Split) -> Iterator[pa.RecordBatch]:
        with open(split.path, "rb") as f:
            found, n, packets = split.walk(f), split.first, split.first_packet
            rows: list[tuple] = []
            held = 0
            for x in found.run(split.past):
                if isinstance(x, Damage):
                    if self.strict:
                        raise CaptureError(f"{split.path}: {x.message} {n}")
                    rows.append((split.path, n, None, None, None, None, None, f"{x.message} at byte {x.offset}"))
                else:
                    whole = x.size >= ETHERNET_HEADER
                    rows.append((split.path, n, packets if whole else None, x.ts_ns, x.size, x.original, x.data, None))
                    packets, held = packets + whole, held + x.size
                n += 1
                if len(rows) >= BATCH or held >= BATCH_BYTES:
                    yield from self.passed(rows)
                    rows, held = [], 0
            yield from self.passed(rows)

    def passed(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        named = [*_NAMES, "error"]
        plain = pa.RecordBatch.from_arrays([pa.array(c, self.schema.field(k).type) for k, c in zip(named, zip(*rows, strict=True), strict=True)], named)
        asked = {column for _, column, _ in self.filters}
        early = [k for k in self.header if k in asked]
        made = dict(zip(early, decoded(plain, {}, early), strict=True))
        of = lambda k: made[k] if k in made else plain.column(k)
        keep = None
        for kind, column, value in self.filters:
            mask = pc.fill_null(_TESTS[kind](of(column), value), False)
            keep = mask if keep is None else pc.and_(keep, mask)
        if keep is not None:
            plain, made = plain.filter(keep), {k: v.filter(keep) for k, v in made.items()}
        if not len(plain):
            return
        late = [k for k in self.header if k not in made]
        made |= dict(zip(late, decoded(plain, {}, late), strict=True))
        yield pa.RecordBatch.from_arrays([of(f.name).cast(f.type) for f in self.schema], schema=self.schema)


def _compared(test):
    return lambda values, value: test(values, pa.scalar(value, values.type))


_TESTS = {
    "EqualTo": _compared(pc.equal), "GreaterThan": _compared(pc.greater), "GreaterThanOrEqual": _compared(pc.greater_equal), "LessThan": _compared(pc.less), "LessThanOrEqual": _compared(pc.less_equal),
    "IsNull": lambda values, _: values.is_null(), "IsNotNull": lambda values, _: values.is_valid(), "StringContains": lambda values, value: pc.match_substring(values, value),
    "In": lambda values, value: pc.is_in(values, pa.array([v for v in value if v is not None], values.type)),
}


class CaptureReader(DataSourceReader):
    """Each pushed filter is a test on a plain column, decided before a frame becomes a row."""

    def __init__(self, options: dict):
        self.options, self.filters = options, []
        self.header = [k for k in options.get("header", "").split(",") if k]
        self.strict = options.get("mode", "FAILFAST").upper() == "FAILFAST"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {*_NAMES, "error", *self.header} - {"data"}
        for f in filters:
            kind, attribute = type(f).__name__, getattr(f, "attribute", ())
            if kind in _TESTS and len(attribute) == 1 and attribute[0] in known:
                self.filters.append((kind, attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Splits]:
        if "splits" in self.options:
            return pickle.loads(zlib.decompress(base64.b64decode(self.options["splits"])))
        return [Splits([Split(path)]) for path in _listed(self.options["path"])]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        # Spark copies the classes of a source to its workers; the code that reads is the module's own.
        from packloom.sources import pcap

        batches = pcap._Batches(self.header, self.filters, self.strict)
        for split in partition.splits:
            yield from batches.of(pcap.Split(**vars(split)))

    def __getstate__(self) -> dict:
        """What each task gets: its own splits come as its partition, not with those of all tasks."""
        return {**vars(self), "options": {k: v for k, v in self.options.items() if k != "splits"}}


def schema_of(header: list[str]) -> str:
    return ", ".join([SCHEMA, "error string", *[f"{k} {HEADER[k]}" for k in header]])


class CaptureSource(DataSource):
    """Options: path (a file or pattern; a folder to write to), resolutions (to write pcapng, of its interfaces), mode (FAILFAST, or PERMISSIVE to go on behind damage, which
    becomes rows with `error` and no data), header (columns of dissect.HEADER, with commas between them)."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return schema_of([k for k in self.options.get("header", "").split(",") if k])

    def reader(self, schema):
        self.planned = True
        return CaptureReader(dict(self.options))

    def __getstate__(self) -> dict:
        """Once there is a reader, only tasks get a copy."""
        return {**vars(self), "options": {k: v for k, v in self.options.items() if k != "splits"}} if hasattr(self, "planned") else vars(self)

    def streamReader(self, schema):
        from ..streaming.growing import GrowingReader

        return GrowingReader(self.options)

    def writer(self, schema, overwrite):
        resolutions = [int(r) for r in self.options.get("resolutions", "").split(",") if r]
        return PcapngWriter(self.options["path"], overwrite, resolutions) if resolutions else CaptureWriter(self.options["path"], overwrite)


def _listed(path: str) -> list[str]:
    paths = sorted(glob.glob(path))
    if not paths:
        raise CaptureError(f"{path}: no such file")
    return paths


def scan_capture(spark: SparkSession, path: str, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES, header: Iterable[str] = ()) -> DataFrame:
    """All records of the capture files that match the path: the columns of SCHEMA, `error`, and those of `header`. In mode
    PERMISSIVE damage is a row with its frame number and an error, and the scan goes on at the next sound record; in mode
    FAILFAST it is an error."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; sources without it aren't affected
    splits = grouped(_splits(spark, [(p, os.path.getsize(p)) for p in _listed(path)], split_bytes), spark.sparkContext.defaultParallelism)
    packed = base64.b64encode(zlib.compress(pickle.dumps(splits))).decode()
    return spark.read.format("capture").options(path=path, mode=mode, header=",".join(header), splits=packed).load()


def read_capture(spark: SparkSession, path: str, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of the capture files that match the path. mode PERMISSIVE passes over damage (capture_errors() has it)."""
    return scan_capture(spark, path, mode, split_bytes).filter("error is null").select(*_NAMES)


def capture_errors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The damaged records of the files: capture, frame_no, error."""
    return scan_capture(spark, path, "PERMISSIVE", split_bytes).filter("error is not null").select("capture", "frame_no", "error")


def parse_capture(content: bytes, path: str = "", strict: bool = True) -> list[tuple]:
    """Rows of a small capture that is at hand as bytes, without its damaged records or failing at them."""
    f = io.BytesIO(content)
    sniff(content[:4])
    if content[:4] == b"\x0a\x0d\x0d\x0a":
        for _ in walk(f, path).run(len(content), data=False):  # all interfaces are checked before any packet is read
            pass
    out, packets = [], 0
    for n, x in enumerate(walk(f, path).run(len(content))):
        if isinstance(x, Damage):
            if strict:
                raise CaptureError(f"{path}: {x.message} {n}")
            continue
        whole = x.size >= ETHERNET_HEADER
        out.append((path, n, packets if whole else None, x.ts_ns, x.size, x.original, x.data))
        packets += whole
    return out


def read_small_captures(spark: SparkSession, path: str) -> DataFrame:
    """Many small files through Spark's own file source, on any file system: a file a row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(parse_capture(content, p), columns=_NAMES).astype({"packet_index": "Int64", "ts_ns": "Int64"})

    return files.mapInPandas(rows, SCHEMA)


# ---- sinks


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str
    packets: int


class FileWriter(DataSourceArrowWriter):
    """A file for each task. Tasks write into a folder of the job's own beside the results; commit() moves the files of
    the attempts that count into place, in place of earlier ones if it overwrites, and abort() leaves nothing behind."""

    suffix = ""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.id = folder, overwrite, uuid.uuid4().hex
        self.job = f"{folder}/_job-{self.id}"
        os.makedirs(folder, exist_ok=True)

    def begin(self, f) -> None:
        pass

    def put(self, f, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        os.makedirs(self.job, exist_ok=True)
        path = f"{self.job}/{part:05d}-{uuid.uuid4().hex}"
        with open(path, "wb") as f:
            self.begin(f)
            for b in iterator:
                self.put(f, b)
                n += len(b)
        return Written(part, path, n)

    def commit(self, messages: list[Written | None]) -> None:
        for old in glob.glob(f"{glob.escape(self.folder)}/part-*{self.suffix}") if self.overwrite else ():
            os.remove(old)
        for m in messages:
            os.replace(m.path, f"{self.folder}/part-{m.part:05d}-{self.id}{self.suffix}")
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


def pcap_record(ts_ns: int, data: bytes, original: int | None = None) -> bytes:
    return struct.pack("<4I", ts_ns // 1_000_000_000, ts_ns % 1_000_000_000, len(data), original or len(data)) + data


class CaptureWriter(FileWriter):
    """Frames (ts_ns, data, orig_len) as nanosecond pcaps; a frame without a time has 0."""

    suffix = ".pcap"

    def begin(self, f) -> None:
        f.write(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 262144, ETHERNET))

    def put(self, f, batch: pa.RecordBatch) -> None:
        for ts, data, original in zip(*(batch.column(c).to_pylist() for c in ("ts_ns", "data", "orig_len")), strict=True):
            f.write(pcap_record(ts or 0, data, original))


#: Frames in a section of a written pcapng file.
SECTION_FRAMES = 10_000


class PcapngWriter(FileWriter):
    """Frames (ts_ns, data, orig_len, and the number of their `interface`) as pcapng files of sections of SECTION_FRAMES frames.
    resolutions: each interface's, as a power of ten. A frame without a time is a simple packet, which has no cut length."""

    suffix = ".pcapng"

    def __init__(self, folder: str, overwrite: bool, resolutions: list[int]):
        super().__init__(folder, overwrite)
        self.resolutions, self.written = resolutions, 0

    def block(self, kind: int, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    def put(self, f, batch: pa.RecordBatch) -> None:
        for ts, data, original, which in zip(*(batch.column(c).to_pylist() for c in ("ts_ns", "data", "orig_len", "interface")), strict=True):
            if self.written % SECTION_FRAMES == 0:
                f.write(self.block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
                for r in self.resolutions:
                    f.write(self.block(1, struct.pack("<HHIHHB3xHH", ETHERNET, 0, 0, 9, 1, r, 0, 0)))
            self.written += 1
            if ts is None:
                f.write(self.block(3, struct.pack("<I", len(data)) + data))
            else:
                ticks = ts * 10 ** self.resolutions[which] // 1_000_000_000
                f.write(self.block(6, struct.pack("<5I", which, ticks >> 32, ticks & 0xFFFFFFFF, len(data), original) + data))


def write_pcaps(frames: DataFrame, folder: str) -> DataFrame:
    """Writes each partition of `frames` as a nanosecond pcap in a folder that executors share, and
    returns path and number of packets of each file there."""
    spark = frames.sparkSession
    spark.dataSource.register(CaptureSource)
    frames.select("ts_ns", "data", "orig_len").write.format("capture").mode("overwrite").save(folder)
    written = scan_capture(spark, f"{glob.escape(folder)}/part-*.pcap").groupBy("capture").count()
    return written.select(written["capture"].alias("path"), written["count"].alias("packets"))
