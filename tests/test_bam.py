"""BAM files written in plain Python read back, in any number of tasks."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

from strandweave.operators import intervals
from strandweave.sources import bam

OPS = "MIDNSHP=X"


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(ref, pos, name, flag, cigar, bases, tags):
    raw = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(raw), 60, 4680, len(cigar), flag, bases, -1, -1, 0) + raw
    body += b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in cigar) + bytes((bases + 1) // 2) + b"\xff" * bases + tags
    return struct.pack("<i", len(body)) + body


def made(rng, count, refs):
    rows, raw, lines = [], [], [f"@SQ\tSN:{n}\tLN:{size}" for n, size in refs]
    for k in range(count):
        ref, flag = rng.randrange(-1, len(refs)), rng.choice((0, 16, 4, 20, 256))
        cigar = [(rng.randint(1, 400), rng.choice(OPS)) for _ in range(rng.randint(0, 6))]
        used, covered = (sum(n for n, o in cigar if o in kinds) for kinds in ("MI=X", "MDN=X"))
        pos, nm, xm = (rng.randint(0, 5000) if ref >= 0 else -1), rng.choice((None, rng.randint(0, 90))), sum(n for n, o in cigar if o == "X")
        tags = b"XAZ" + b"x" * rng.randint(0, 30) + b"\0"
        tags += b"XBBs" + struct.pack("<ihh", 2, 5, 6) + b"XCfabcd"
        tags += (b"NMC" + bytes([nm]) if nm is not None else b"")
        bases = rng.choice((0, 10, 3000))
        raw.append(record(ref, pos, f"n{k}.1_m{k}.2", flag, cigar, bases, tags))
        where = (refs[ref][0], pos, pos + covered, refs[ref][1]) if ref >= 0 else (None,) * 4
        rows.append((f"n{k}.1_m{k}.2", where[0], bool(flag & 4), not flag & 16, *where[1:], used, nm, xm))
        lines.append("\t".join([f"n{k}.1_m{k}.2", str(flag), where[0] or "*", str(pos + 1), "60", "".join(f"{n}{o}" for n, o in cigar) or "*", "*", "0", "0", "*", "*"] + ([f"NM:i:{nm}"] if nm is not None else [])))
    return rows, b"".join(raw), lines


@pytest.mark.parametrize("size", [700, 60_000])
def test_bam_reads_back_in_any_number_of_tasks(spark, tmp_path, size):
    rng = random.Random(size)
    refs = [(f"x_chr{k}", rng.randint(6000, 10**6)) for k in range(30)]
    rows, raw, lines = made(rng, 600, refs)
    text = "\n".join(lines[:30]).encode()
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 30) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in refs) + raw
    whole = b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")  # records cross blocks
    path = tmp_path / "a.bam"
    path.write_bytes(whole)
    for split in (len(whole), len(whole) // 3 + 1, len(whole) // 17 + 1):
        df = bam.read_bam(spark, str(path), split)
        assert df.rdd.getNumPartitions() == -(-len(whole) // split)
        assert sorted(map(tuple, df.collect())) == sorted(rows)
    sam = bam.sam_records(spark.createDataFrame([(x,) for x in [*lines, "", None]], "value string"))
    assert sorted(map(tuple, sam.collect()), key=str) == sorted(rows, key=str)
    kept = intervals.oriented(intervals.filtered(df.filter("reference_name is not null"), 0.5))
    assert kept.count() == 2 * len([r for r in rows if r[1] and not r[2] and r[7] and (r[7] - (r[8] if r[8] is not None else r[9])) / r[7] >= 0.5])


def test_files_without_records_and_damaged_ones(spark, tmp_path):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 0)
    (tmp_path / "e.bam").write_bytes(block(head) + block(b""))
    assert bam.read_bam(spark, str(tmp_path / "e.bam")).count() == 0
    (tmp_path / "d.bam").write_bytes(block(b"SAM\x01" + head))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "d.bam")).count()
