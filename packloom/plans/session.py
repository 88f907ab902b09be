"""Sessions: open captures and the tools that work on them."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, streams, summaries
from ..operators.dissect import dissect
from ..sources.pcap import read_capture
from ..sources.tables import read_certificates, reassemble
from .display_filter import display_filter

MOST_SESSIONS, IDLE_SECONDS, MOST_PACKETS = 8, 15 * 60, 1_000_000


class SessionError(ValueError):
    pass


@dataclass
class Capture:
    """An open capture: its packets, cached, and the findings once they are asked for."""

    packets: DataFrame
    frames: DataFrame
    used: float
    findings: DataFrame | None = None
    notes: dict[str, str] = field(default_factory=dict)


class Sessions:
    """One method per tool. Results are DataFrames, so that nothing large reaches the driver
    unless the caller collects it."""

    def __init__(self, spark: SparkSession, most: int = MOST_SESSIONS, idle_seconds: float = IDLE_SECONDS, clock=time.monotonic):
        self.spark, self.most, self.idle, self.clock = spark, most, idle_seconds, clock
        self.open: dict[str, Capture] = {}

    def _expire(self) -> None:
        for name, c in list(self.open.items()):
            if self.clock() - c.used > self.idle:
                self.close_capture(name)

    def _get(self, session: str) -> Capture:
        self._expire()
        if session not in self.open:
            raise SessionError(f"unknown session {session}")
        self.open[session].used = self.clock()
        return self.open[session]

    def open_frames(self, frames: DataFrame, max_packets: int | None = 100_000) -> str:
        """Opens frames; more than max_packets are an error, not cut off."""
        self._expire()
        if len(self.open) >= self.most:
            raise SessionError(f"at most {self.most} captures can be open")
        frames = summaries.check_limit(frames, None if max_packets is None else min(max_packets, MOST_PACKETS))
        packets = dissect(streams.with_packet_index(frames))
        packets = streams.with_stream_id(streams.narrow(packets, packets.columns)).persist()
        name = uuid.uuid4().hex
        self.open[name] = Capture(packets, frames, self.clock())
        return name

    def open_capture(self, path: str, max_packets: int | None = 100_000) -> str:
        return self.open_frames(read_capture(self.spark, path), max_packets)

    def close_capture(self, session: str) -> None:
        if session not in self.open:
            raise SessionError(f"unknown session {session}")
        capture = self.open.pop(session)
        capture.packets.unpersist()
        if capture.findings is not None:
            capture.findings.unpersist()

    def describe_capture(self, session: str) -> dict:
        return summaries.describe_capture(self._get(session).packets)

    def list_packets(self, session: str, offset: int = 0, limit: int = 100, filter: str | None = None, **conditions) -> DataFrame:
        matching = display_filter(filter) if filter else None
        found = summaries.search(self._get(session).packets, matching=matching, exact=True, **conditions)
        return summaries.page(found, ["packet_index"], offset, limit)

    search_packets = list_packets

    def get_packet(self, session: str, packet_index: int) -> DataFrame:
        found = self._get(session).packets.filter(F.col("packet_index") == packet_index)
        if found.isEmpty():
            raise SessionError(f"no packet {packet_index}")
        return found

    def list_decode_issues(self, session: str, kind: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        return summaries.page(summaries.decode_issues(self._get(session).packets, kind), ["packet_index", "place"], offset, limit)

    def summarize_protocols(self, session: str) -> DataFrame:
        return summaries.protocol_counts(self._get(session).packets).orderBy(F.desc("packets"), "protocol")

    def top_endpoints(self, session: str, limit: int = 10) -> DataFrame:
        return summaries.top_endpoints(self._get(session).packets, limit)

    def audit_capture(self, session: str, profile: str | None = None) -> DataFrame:
        return audit.audit(self._get(session).packets, profile).orderBy("step", "sort_key")

    def _findings(self, session: str) -> DataFrame:
        capture = self._get(session)
        if capture.findings is None:
            capture.findings = audit.audit(capture.packets).persist()
        return capture.findings

    def list_findings(self, session: str, severity: str | None = None, category: str | None = None) -> DataFrame:
        found, notes = audit.listed(self._findings(session), severity, category), self.open[session].notes
        known = F.from_json(F.lit("{}"), "map<string,string>") if not notes else F.create_map(*[F.lit(x) for kv in notes.items() for x in kv])
        note = F.try_element_at(known, F.col("id"))
        return found.withColumns({"notes": note, "escalated": note.isNotNull()}).orderBy("step", "sort_key")

    def explain_finding(self, session: str, finding_id: str) -> DataFrame:
        found = audit.explained(self._findings(session), finding_id)
        if found.isEmpty():
            raise SessionError(f"no finding {finding_id}")
        return found

    def escalate_finding(self, session: str, finding_id: str, notes: str) -> None:
        """The last note on a finding counts."""
        self.explain_finding(session, finding_id)
        self.open[session].notes[finding_id] = notes

    def list_streams(self, session: str, offset: int = 0, limit: int = 100) -> DataFrame:
        return summaries.page(streams.describe_streams(streams.streams(self._get(session).packets)), ["stream_id"], offset, limit)

    def get_stream(self, session: str, stream_id: int) -> DataFrame:
        return streams.stream_packets(self._get(session).packets.drop("stream_id"), stream_id)

    def get_stream_payload(self, session: str, stream_id: int) -> DataFrame:
        """Payload segments of a TCP conversation by direction and sequence number."""
        capture = self._get(session)
        sent = capture.packets.filter((F.col("stream_id") == stream_id) & (F.col("payload_len") > 0)).select("capture", "frame_no", "packet_index", "stream_key", "src_ip", "tcp", "payload_at", "payload_len")
        data = capture.frames.select("capture", "frame_no", "data")
        return reassemble(sent.join(data, ["capture", "frame_no"]).withColumn("payload", F.expr("substring(data, payload_at + 1, payload_len)")))

    def get_certificates(self, path: str) -> DataFrame:
        """Certificates of an exported table; the capture itself isn't searched for them."""
        return read_certificates(self.spark, path)

    def summarize_capture(self, session: str) -> DataFrame:
        found = self._findings(session).agg(F.count(F.lit(1)).alias("finding_count"))
        return summaries.capture_summary(self._get(session).packets).crossJoin(F.broadcast(found))  # a row each

    def compare_captures(self, a: str, b: str) -> DataFrame:
        return summaries.compare(self._get(a).packets, self._get(b).packets)
