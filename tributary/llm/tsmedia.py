"""Media columns: MPEG transport streams.

``store`` wraps a payload as the elementary stream of one program: a program association table, a program map
table, and elementary packets of up to ``FRAME`` blocks, each with a time stamp and beginning at a random-access
point; tables are repeated before every such point. ``read`` trusts nothing of that: it checks sync bytes, puts
sections together from as many packets as they take, checks their checksums, follows one program's elementary stream
(the first, or the one asked for), drops the duplicate packets that the standard allows, counts breaks of continuity
counters, reassembles elementary packets and lists time stamps with their random-access points. Elementary packets
that a break or a wrong length damages are counted; what is left of them is kept. ``features`` stores time stamps and
random-access points (packet numbers) as array columns.

A payload is a text's UTF-8 with bytes 255 up to a positive multiple of ``BLOCK``; null texts count as empty
(one block of 255). Equal texts give equal streams; repeated rows are stored each by itself; an empty table
gives an empty result; other columns are ignored. ``read`` raises on what isn't a transport stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import map_columns

PACKET, BLOCK, FRAME, TICKS = 188, 576, 64, 1080  # 576 samples at 48 kHz are 1080 ticks of 90 kHz
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
PMT = _section(2, PROGRAM, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    data = (text or "").encode()
    n = len(data)
    return data + b"\xff" * (max(BLOCK, -(-n // BLOCK) * BLOCK) - n), n


def _stamp(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes((0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE))


def store(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``."""
    out, counter = [], {0: 0, PMT_PID: 0, ES_PID: 0}

    def packet(pid: int, start: bool, body: bytes, extra: bytes | None = None) -> None:
        room = 184 - len(body)
        field_ = b""
        if extra is not None or room:
            flags = extra if extra is not None else (b"\0" if room > 1 else b"")
            stuffing = room - 1 - len(flags)
            field_ = bytes((room - 1,)) + flags + b"\xff" * stuffing
        out.append(struct.pack(">BHB", 0x47, (0x4000 if start else 0) | pid, (0x30 if field_ else 0x10) | counter[pid]) + field_ + body)
        counter[pid] = (counter[pid] + 1) & 15

    for at in range(0, len(payload), BLOCK * FRAME):
        for pid, section in ((0, PAT), (PMT_PID, PMT)):
            packet(pid, True, (b"\0" + section).ljust(184, b"\xff"))
        t = at // BLOCK * TICKS
        frame = payload[at : at + BLOCK * FRAME]
        pes = struct.pack(">3sBHBBB", b"\0\0\1", STREAM_ID, len(frame) + 8, 0x80, 0x80, 5) + _stamp(t) + frame
        # Random access and clock reference: 33 bits of 90 kHz, six reserved, nine of 27 MHz.
        extra = b"\x50" + struct.pack(">Q", t << 15 | 0x3F << 9)[2:]
        first = min(len(pes), 184 - 1 - len(extra))
        packet(ES_PID, True, pes[:first], extra)
        for lo in range(first, len(pes), 184):
            packet(ES_PID, False, pes[lo : lo + 184])
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: elementary stream, its identity, frames ``(time stamp, packet, random access)``."""

    pid: int = -1
    kind: int = -1
    data: bytes = b""
    frames: list[tuple[int | None, int, bool]] = field(default_factory=list)
    packets: int = 0
    counter_errors: int = 0
    duplicates: int = 0
    damaged: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number to the place of its table

    @property
    def feature(self) -> str:
        stamps = [t for t, _, _ in self.frames if t is not None]
        first, last = (stamps[0], stamps[-1]) if stamps else (-1, -1)
        return f"pid={self.pid};type={self.kind};packets={self.packets};pes={len(self.frames)};pts={first}-{last};rap={sum(r for _, _, r in self.frames)};cc_errors={self.counter_errors};damaged={self.damaged}"


def _checked(section: bytes, table: int) -> bytes:
    if section[0] != table or crc_mpeg(section):
        raise ValueError("damaged program table")
    return section[8:-4]


class _Sections:
    """Sections of one packet identifier, put together from the packets that carry them."""

    def __init__(self):
        self.held = b""

    def feed(self, body: bytes, start: bool) -> list[bytes]:
        out = []
        if start:
            ahead, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if self.held:
                self.held += ahead
                out += self._whole()
            self.held = body
        elif self.held:
            self.held += body
        return out + self._whole()

    def _whole(self) -> list[bytes]:
        out = []
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            end = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
            if len(self.held) < end:
                return out
            out.append(self.held[:end])
            self.held = self.held[end:]
        if self.held[:1] == b"\xff":  # stuffing up to the packet's end
            self.held = b""
        return out


def _elementary(pes: bytes) -> tuple[int | None, bytes]:
    if pes[:3] != b"\0\0\1":
        raise ValueError("elementary packet without start code")
    size, flags, more = pes[4] << 8 | pes[5], pes[7], pes[8]
    t = None
    if flags & 0x80:
        p = pes[9:14]
        t = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
    return t, pes[9 + more : 6 + size if size else None]


def read(media: bytes, program: int | None = None) -> Stream:
    """Parse a transport stream: the elementary stream of ``program``, or of the first one listed."""
    if len(media) % PACKET or not media:
        raise ValueError("not a whole number of packets")
    out, pmt, data = Stream(packets=len(media) // PACKET), -1, []
    last: dict[int, tuple[int, bytes]] = {}
    sections: dict[int, _Sections] = {}
    parts: list[bytes] = []
    began, broken = (0, False), False

    def close() -> None:
        if parts:
            pes = b"".join(parts)
            t, body = _elementary(pes)
            size = pes[4] << 8 | pes[5]
            out.damaged += broken or bool(size) and len(pes) != 6 + size
            data.append(body)
            out.frames.append((t, *began))
            parts.clear()

    for k in range(out.packets):
        p = media[k * PACKET : (k + 1) * PACKET]
        if p[0] != 0x47:
            raise ValueError("lost sync")
        pid, start, control = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] & 0x30
        at, access, jump = 4, False, False
        if control & 0x20:
            access, jump = p[4] > 0 and bool(p[5] & 0x40), p[4] > 0 and bool(p[5] & 0x80)
            at += 1 + p[4]
        if not control & 0x10 or pid == 0x1FFF:
            continue
        count, body = p[3] & 15, p[at:]
        if pid in last and not jump:
            if last[pid] == (count, body):  # sent twice
                out.duplicates += 1
                continue
            if (last[pid][0] + 1) & 15 != count:
                out.counter_errors += 1
                broken = broken or pid == out.pid
        last[pid] = count, body
        if pid == 0 or pid == pmt:
            for section in sections.setdefault(pid, _Sections()).feed(body, start):
                if pid == 0:
                    listed = _checked(section, 0)
                    out.programs |= {n: (listed[i + 2] & 0x1F) << 8 | listed[i + 3] for i in range(0, len(listed), 4) if (n := listed[i] << 8 | listed[i + 1])}
                    if not out.programs or program is not None and program not in out.programs:
                        raise ValueError("no such program")
                    pmt = out.programs[program] if program is not None else next(iter(out.programs.values()))
                elif section[0] == 2:
                    streams = _checked(section, 2)
                    i = 4 + ((streams[2] & 0x0F) << 8 | streams[3])
                    out.kind, out.pid = streams[i], (streams[i + 1] & 0x1F) << 8 | streams[i + 2]
        elif pid == out.pid:
            if start:
                close()
                broken, began = False, (k, access)
            if start or parts:
                parts.append(body)
    close()
    out.data = b"".join(data)
    return out


def media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text as a transport stream."""

    def make():
        def run(ids, texts):
            made = [payload_of(t) for t in texts]
            return {"doc_id": ids, "n_bytes": [n for _, n in made], "media": [store(p) for p, _ in made]}

        return run

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary", make, 500)


def features(stored: DataFrame) -> DataFrame:
    """Read ``media`` back and describe it."""

    def make():
        def run(ids, sizes, streams):
            out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "access_points")}
            for m in streams:
                s = read(m)
                for k, v in (("payload_bytes", len(s.data)), ("payload_sha256", hashlib.sha256(s.data).hexdigest()), ("tail_crc32", zlib.crc32(s.data[-32:])), ("media_bytes", len(m)), ("media_sha256", hashlib.sha256(m).hexdigest()), ("feature", s.feature), ("stamps", [t for t, _, _ in s.frames]), ("access_points", [k for _, k, r in s.frames if r])):
                    out[k].append(v)
            return {"doc_id": ids, "n_bytes": sizes, **out}

        return run

    rows = stored.select("doc_id", "n_bytes", "media")
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, access_points array<long>", make, 500)
