"""Transport streams not of our own making: tables over several packets, several programs, duplicates, losses."""

import struct

import pytest

from tributary.llm import tsmedia as ts

P = ts.PACKET


def packets(media):
    return [media[i : i + P] for i in range(0, len(media), P)]


def test_duplicates_are_dropped():
    media = packets(ts.store(bytes(range(256)) * 9 * 30))
    twice = b"".join(p * 2 if i in (0, 5, 40) else p for i, p in enumerate(media))
    plain, got = ts.read(b"".join(media)), ts.read(twice)
    assert (got.data, got.counter_errors, got.duplicates, got.damaged) == (plain.data, 0, 3, 0)


def test_losses_are_counted():
    media = packets(ts.store(bytes(576 * 64 * 3)))
    first = next(i for i, p in enumerate(media) if i > 10 and p[1] & 0x40 and (p[1] & 0x1F) << 8 | p[2] == ts.ES_PID)
    for lost, damaged in ((6, 1), (first + 3, 1)):
        got = ts.read(b"".join(media[:lost] + media[lost + 1 :]))
        assert (got.counter_errors, got.damaged, len(got.frames)) == (1, damaged, 3) and len(got.data) < 576 * 64 * 3


def test_sections_over_packets_and_programs():
    inner = packets(ts.store(b"x" * 576))
    many = [(n, 0x300 + n) for n in range(2, 90)] + [(ts.PROGRAM, ts.PMT_PID)]
    pat = b"\0" + ts._section(0, 1, b"".join(struct.pack(">HH", n, 0xE000 | pid) for n, pid in many))
    carried = []
    for i, at in enumerate(range(0, len(pat), 184)):
        carried.append(struct.pack(">BHB", 0x47, 0x4000 if i == 0 else 0, 0x10 | i) + pat[at : at + 184].ljust(184, b"\xff"))
    assert len(carried) > 1
    media = b"".join(carried + inner[1:])
    got = ts.read(media, ts.PROGRAM)
    assert got.data == b"x" * 576 and len(got.programs) == 89 and ts.read(media).pid == -1
    with pytest.raises(ValueError):
        ts.read(media, 500)


def test_stamps_are_columns(spark):
    docs = spark.createDataFrame([(1, "a" * 80_000, "s"), (2, None, "s")], "doc_id long, text string, stamps string")
    got = {r.doc_id: r for r in ts.features(ts.media(docs)).collect()}
    assert got[1].stamps == [0, 64 * 1080, 128 * 1080] and len(got[1].access_points) == 3 and got[2].stamps == [0]
