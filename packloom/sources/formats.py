"""Walks over pcap and pcapng files from any byte on.

A walk goes from record to record. Where a record can't be right (it is larger than a file's records may
be, it reaches past the end, or a block's two lengths differ), that is damage: the walk yields it and goes on at
the next sound record. A record is sound if a chain of CHAIN plausible records starts there, or one that
ends with the file.

sound() also guesses where the first record of a byte range starts. A payload can hold something that looks like
records, so a guess is only that; splits confirm it by the end of the range before (pcap.py).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Magic numbers by byte order and time unit, the link type of Ethernet, types of blocks.
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG, ETHERNET, MOST_INTERFACES, ETHERNET_HEADER = b"\x0a\x0d\x0d\x0a", 1, 65535, 14
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
SMALLEST = {SECTION: 28, INTERFACE: 20, SIMPLE: 16, ENHANCED: 32}
BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
#: Records are at most as large as a pcap's header says, or this; blocks at most so large.
MOST_RECORD, MOST_BLOCK = 1 << 18, 1 << 26
#: Plausible records in a row that make a sound one; bytes searched at once.
CHAIN, SEARCHED = 3, 1 << 18


class CaptureError(ValueError):
    """A file that is no capture, has a link type other than Ethernet, or is damaged."""


@dataclass
class Frame:
    ts_ns: int | None
    size: int
    original: int
    data: bytes | None


@dataclass
class Damage:
    offset: int
    message: str


def sniff(magic: bytes) -> str:
    if magic[:4] in PCAP:
        return "pcap"
    if magic[:4] == PCAPNG:
        return "pcapng"
    raise CaptureError("unsupported capture format")


class _Walk:
    """self.at is where the next record starts; None while a search has met the end of its range."""

    def __init__(self, f, path: str):
        self.f, self.path, self.end = f, path, f.seek(0, 2)
        self.bad: set[int] = set()

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def run(self, past: int, data: bool = True):
        """Frames and damage of the records that start before `past`."""
        while self.at is not None and self.at < min(past, self.end):
            yield from self.step(past, data)

    def damage(self, at: int, message: str, go_on: int, past: int):
        self.at = self.sound(go_on, past)
        return Damage(at, message)

    def sound(self, at: int, past: int) -> int | None:
        """Where the first sound record from `at` on starts, if before `past` or at the file's end."""
        at = -(-at // self.aligned) * self.aligned
        while at < min(past, self.end):
            raw = self.read(at, SEARCHED + 16)
            for c in self.candidates(raw, min(SEARCHED, past - at)):
                if self.chained(at + c):
                    return at + c
            at += SEARCHED
        return self.end if past >= self.end else None

    def chained(self, at: int) -> bool:
        """Whether a chain starts here. Each place is looked at once, as chains meet."""
        seen: list[int] = []
        while len(seen) < CHAIN and at not in self.bad:
            if at == self.end and seen:
                return True
            size = self.plausible(at)
            if size is None or at + size > self.end:
                break
            seen.append(at)
            at += size
        if len(seen) == CHAIN:
            return True
        self.bad.update(seen)
        return False


class PcapWalk(_Walk):
    kind, aligned, order_now = "pcap", 1, ""

    def __init__(self, f, path: str, at: int | None = 24):
        super().__init__(f, path)
        head = self.read(0, 24)
        if len(head) < 24:
            raise CaptureError(f"{path}: truncated header")
        self.order, self.unit = PCAP[head[:4]]
        snap, link = struct.unpack(self.order + "II", head[16:])
        if link & 0x0FFFFFFF != ETHERNET:
            raise CaptureError(f"{path}: unsupported link type {link & 0x0FFFFFFF}")
        self.most, self.fractions, self.at = max(snap, MOST_RECORD) if snap < 1 << 30 else MOST_RECORD, 1_000_000_000 // self.unit, at
        self.sections, self.interfaces, self.need = 0, [], 0

    def step(self, past: int, data: bool):
        at, head = self.at, self.read(self.at, 16)
        seconds, fraction, size, original = struct.unpack(self.order + "4I", head) if len(head) == 16 else (0, 0, 0, 0)
        if len(head) == 16 and size > self.most:
            yield self.damage(at, f"record of {size} bytes", at + 1, past)
        elif len(head) < 16 or at + 16 + size > self.end:
            yield self.damage(at, "truncated record", at + 1, past)
        else:
            self.at = at + 16 + size
            yield Frame(seconds * 1_000_000_000 + fraction * self.unit, size, max(original, size), self.f.read(size) if data else None)

    def plausible(self, at: int) -> int | None:
        head = self.read(at, 16)
        if len(head) < 16:
            return None
        _, fraction, size, original = struct.unpack(self.order + "4I", head)
        return 16 + size if fraction < self.fractions and 0 < size <= self.most and size <= original < 1 << 24 else None

    def candidates(self, raw: bytes, n: int) -> list[int]:
        n = min(n, len(raw) - 15)
        if n <= 0:
            return []
        fraction, size, original = (np.ndarray((n,), self.order + "u4", raw, 4 * k, (1,)) for k in (1, 2, 3))
        return np.flatnonzero((fraction < self.fractions) & (size > 0) & (size <= self.most) & (original >= size) & (original < 1 << 24)).tolist()


class PcapngWalk(_Walk):
    """interfaces: the time resolutions of the section's interfaces so far; sections: section headers met. A walk that
    starts inside a section whose interfaces it isn't told has `need` of so many of them."""

    kind, aligned = "pcapng", 4

    def __init__(self, f, path: str, at: int | None = 0, order: str = "<", interfaces: list[int] | None = None):
        super().__init__(f, path)
        self.at, self.order_now, self.inherited, self.bad_by = at, order, interfaces is None, {"<": set(), ">": set()}
        self.interfaces, self.sections, self.need = list(interfaces or []), 0, 0

    def block(self, at: int, order: str) -> tuple[int, int, str] | None:
        """Type, length and byte order of a block whose two lengths agree."""
        head = self.read(at, 12)
        if len(head) < 12:
            return None
        order = BYTE_ORDER.get(head[8:], "?") if head[:4] == PCAPNG else order
        if order == "?":
            return None
        kind, size = struct.unpack(order + "II", head[:8])
        if size < SMALLEST.get(kind, 12) or size % 4 or size > MOST_BLOCK or at + size > self.end or self.read(at + size - 4, 4) != head[4:8]:
            return None
        return kind, size, order

    def step(self, past: int, data: bool):
        at, found = self.at, self.block(self.at, self.order_now)
        if found is None:
            yield self.damage(at, "damaged block", at + 4, past)
            return
        kind, size, order = found
        self.at = at + size
        if kind == SECTION:
            self.order_now, self.interfaces, self.inherited = order, [], False
            self.sections += 1
        elif kind == INTERFACE:
            body = self.read(at + 8, size - 12)
            link = struct.unpack(order + "H", body[:2])[0]
            if link != ETHERNET:
                raise CaptureError(f"{self.path}: unsupported link type {link}")
            if len(self.interfaces) >= MOST_INTERFACES:
                raise CaptureError(f"{self.path}: too many interfaces")
            self.interfaces.append(_resolution(body[8:], order))
        elif kind in (SIMPLE, ENHANCED):
            head = self.read(at + 8, 20 if kind == ENHANCED else 4)
            which = struct.unpack(order + "I", head[:4])[0] if kind == ENHANCED else 0
            if self.inherited:
                self.need = max(self.need, which + 1 - len(self.interfaces))
            elif which >= len(self.interfaces):
                raise CaptureError(f"{self.path}: packet of an unknown interface")
            if kind == ENHANCED:
                high, low, length, original = struct.unpack(order + "4I", head[4:])
                if length > size - 32:
                    yield Damage(at, "packet larger than its block")
                    return
                ts = None if self.inherited else (high << 32 | low) * 1_000_000_000 // ticks(self.interfaces[which])
                yield Frame(ts, length, max(original, length), self.read(at + 28, length) if data else None)
            else:
                original = struct.unpack(order + "I", head)[0]
                length = min(original, size - 16)
                yield Frame(None, length, max(original, length), self.read(at + 12, length) if data else None)

    def plausible(self, at: int) -> int | None:
        """The size of a block. In a chain a section's byte order holds from its header on."""
        found = self.block(at, self.order_now)
        if found is None:
            return None
        self.order_now = found[2]
        return found[1]

    def chained(self, at: int) -> bool:
        now = self.order_now
        for order in dict.fromkeys([now, "<", ">"]):
            self.order_now, self.bad = order, self.bad_by[order]
            if super().chained(at):
                self.order_now = order
                return True
        self.order_now = now
        return False

    def candidates(self, raw: bytes, n: int) -> list[int]:
        n = min(n, len(raw) - 11)
        if n <= 0:
            return []
        at = np.arange(0, n, 4)
        hit = np.zeros(len(at), bool)
        for order in "<>":
            kind, size = (np.ndarray((len(at),), order + "u4", raw, 4 * k, (4,)) for k in (0, 1))
            hit |= np.isin(kind, list(SMALLEST)) & (size >= 12) & (size % 4 == 0) & (size <= MOST_BLOCK)
        return at[hit].tolist()


def _resolution(options: bytes, order: str) -> int:
    """The byte for an interface's time resolution: 10 ** -n, or 2 ** -n with the highest bit; a millionth
    unless its options say otherwise."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "2H", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and size >= 1:
            return options[at + 4]
        at += 4 + (size + 3) // 4 * 4
    return 6


def ticks(resolution: int) -> int:
    return 1 << (resolution & 127) if resolution & 128 else 10**resolution


def walk(f, path: str) -> _Walk:
    """A walk over a whole file."""
    f.seek(0)
    return PcapWalk(f, path) if sniff(f.read(4)) == "pcap" else PcapngWalk(f, path, interfaces=[])
