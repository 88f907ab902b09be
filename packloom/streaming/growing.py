"""Captures that are still being written, as a stream.

An offset has, for each file, how far it is whole: bytes, frames and packets, and a pcapng file's state there. Each trigger
walks the record headers of what has come since, once and on the driver, and cuts that into splits, of which tasks read runs. A record that is not
all there yet waits, and so does a file without a whole header. Splits follow from two offsets alone, so a
restart from a checkpoint loses and repeats nothing as long as files only grow.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSourceStreamReader

from ..sources.formats import CaptureError, Damage, Frame, PcapngWalk, PcapWalk, sniff
from ..sources.pcap import SPLIT_BYTES, Split, Splits

#: Bytes of a file that one trigger takes at most.
MOST_BYTES = 1 << 32


def advanced(path: str, mark: list | None, most: int = MOST_BYTES, each: int = SPLIT_BYTES, until: int | None = None) -> list[list]:
    """Marks in a file from `mark` (None: its start) on, `each` bytes apart, up to byte `until` or the end of what is whole.
    A mark is [byte, frames, packets, byte order, interfaces]."""
    size = os.path.getsize(path) if until is None else until
    with open(path, "rb") as f:
        magic = f.read(4)
        if size < 28 or len(magic) < 4:
            return [mark] if mark else []
        if mark is None:
            mark = [24 if sniff(magic) == "pcap" else 0, 0, 0, "<", []]
        walk = PcapWalk(f, path, mark[0]) if sniff(magic) == "pcap" else PcapngWalk(f, path, mark[0], mark[3], mark[4])
        walk.end = size
        out, at, frames, packets = [mark], mark[0], mark[1], mark[2]
        while at < size and at - mark[0] < most:
            for x in walk.step(size, data=False):
                if isinstance(x, Damage) and (walk.at is None or walk.at >= size):  # it may be half written: nothing sound follows it yet
                    return out if out[-1][0] == at else [*out, [at, frames, packets, walk.order_now, list(walk.interfaces)]]
                frames += 1
                packets += isinstance(x, Frame) and x.size >= 14
            if walk.at is None or walk.at > size:
                break
            at = walk.at
            if at - out[-1][0] >= each:
                out.append([at, frames, packets, walk.order_now, list(walk.interfaces)])
        return out if out[-1][0] == at else [*out, [at, frames, packets, walk.order_now, list(walk.interfaces)]]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from packloom.streaming import growing

        known, self.walked = getattr(self, "known", {}), getattr(self, "walked", {})
        for path in sorted(glob.glob(self.options["path"])):
            before = known.get(path)
            marks = growing.advanced(path, before, growing.MOST_BYTES, self.each())
            if marks:
                known[path] = marks[-1]
                self.walked[path] = (before, marks)
        self.known = known
        return dict(known)

    def each(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def partitions(self, start: dict, end: dict) -> list[Splits]:
        from packloom.sources import pcap
        from packloom.streaming import growing

        out = []
        for path, mark in sorted(end.items()):
            before, marks = getattr(self, "walked", {}).get(path, (None, None))
            if marks is None or before != start.get(path) or marks[-1] != mark:  # not the step that latestOffset() took, as after a restart
                marks = growing.advanced(path, start.get(path), growing.MOST_BYTES, self.each(), mark[0])
            if marks[-1][0] != mark[0]:
                raise CaptureError(f"{path}: it has become shorter")
            out += [Split(path, a[0], b[0], max(a[0], 1), a[1], a[2], a[3], a[4]) for a, b in zip(marks, marks[1:], strict=False)]
        self.known = {**getattr(self, "known", {}), **end}
        return pcap.grouped(out, int(self.options.get("cores", 1)))

    def read(self, partition: Splits) -> Iterator:
        from packloom.sources import pcap

        batches = pcap._Batches([], [], self.options.get("mode", "FAILFAST").upper() == "FAILFAST")
        for split in partition.splits:
            yield from batches.of(pcap.Split(**vars(split)))

    def __getstate__(self) -> dict:
        """What each task gets: its own splits come as its partition."""
        return {k: v for k, v in vars(self).items() if k not in ("known", "walked")}

    def commit(self, end: dict) -> None:
        pass


def stream_frames(spark, path: str, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES):
    """Frames of the captures that match the path, as they grow and as new ones come."""
    from ..sources.pcap import CaptureSource, _NAMES

    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").options(path=path, mode=mode, splitBytes=str(split_bytes), cores=str(spark.sparkContext.defaultParallelism)).load().filter("error is null").select(*_NAMES)
