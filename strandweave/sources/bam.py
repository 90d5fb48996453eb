"""Alignment files: BAM by blocks in parallel, SAM by lines.

A BAM file is a chain of small compressed blocks. ``BamSource`` cuts it into ranges
of bytes; a task finds the first block that starts in its range by the block's
header, and the first record in it as the first place from which ``CHAIN`` records,
or all up to the end of the data, follow one another with sound fields. It reads
the records that start in blocks of its range, over its end where they go on there.

Rows have the shape that ``operators.intervals`` takes. Damaged blocks raise; a
file without records, or without its end marker, has the rows that are there.
Null or blank lines of SAM are skipped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query_name string, reference_name string, is_unmapped boolean, is_forward boolean, ref_start long, ref_end long, ref_length long, query_alignment_length long, nm long, mismatches long"

#: Bytes of a range that a task reads, unless ``splitBytes`` says otherwise; sound records in a row that show where records start.
SPLIT, CHAIN = 32 << 20, 10
#: Bytes that a compressed block has at most.
BLOCK = 1 << 16
# Fixed values of the file format: a block's first bytes; operations of an alignment by number; sizes of a tag's values by type.
_MAGIC = b"\x1f\x8b\x08\x04"
_OPERATIONS = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def _block_size(head: bytes) -> int | None:
    """The size of the block with these first bytes; None if none starts here."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def _blocks(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Places and contents of the blocks from the one that starts at ``start``."""
    at = start
    while at < size:
        file.seek(at)
        raw = file.read(BLOCK)
        n = _block_size(raw)
        if n is None or n > len(raw):
            raise ValueError(f"no whole block at byte {at}")
        out = zlib.decompress(raw[:n], 31)
        yield at, out
        at += n


def _first_block(file, start: int, stop: int, size: int) -> int | None:
    """Where the first block from ``start`` on, before ``stop``, begins: one that another follows, or the file's end."""
    file.seek(start)
    raw = file.read(min(size, stop + 2 * BLOCK) - start)
    at = raw.find(_MAGIC)
    while 0 <= at < stop - start:
        n = _block_size(raw[at : at + 64])
        if n and (start + at + n == size or _block_size(raw[at + n : at + n + 64])):
            try:
                zlib.decompress(raw[at : at + n], 31)
                return start + at
            except zlib.error:
                pass
        at = raw.find(_MAGIC, at + 1)
    return None


@dataclass
class _Header:
    names: list[str]
    lengths: list[int]
    size: int  # bytes of the header, decompressed


def _header(file, size: int) -> _Header:
    data = b""
    blocks = _blocks(file, 0, size)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            more = next(blocks, None)
            if more is None:
                raise ValueError("the header ends early")
            data += more[1]

    need(12)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    names, lengths = [], []
    for _ in range(count):
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + n)
        names.append(data[at + 4 : at + 3 + n].decode())
        lengths.append(struct.unpack_from("<i", data, at + 4 + n)[0])
        at += 8 + n
    return _Header(names, lengths, at)


def _sound(data: bytes, at: int, refs: int) -> int | None:
    """The size of the record at a place, if its fields are sound; None if not, -1 if it isn't there whole."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, cigar, _, bases, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 32 or not -1 <= ref < refs or not -1 <= next_ref < refs or pos < -1 or next_pos < -1 or name < 1 or bases < 0:
        return None
    if 32 + name + 4 * cigar + (bases + 1) // 2 + bases > size:
        return None
    end = at + 36 + name
    if end <= len(data) and (data[end - 1] != 0 or any(not 33 <= c <= 126 for c in data[at + 36 : end - 1])):
        return None
    return size + 4


def _first_record(data: bytes, refs: int) -> int | None:
    for start in range(len(data)):
        at, seen = start, 0
        while seen < CHAIN:
            n = _sound(data, at, refs)
            if n is None:
                break
            if n < 0 or at + n > len(data):
                seen = CHAIN if seen or n > 0 else 0
                break
            at, seen = at + n, seen + 1
            if at == len(data):
                seen = CHAIN
        if seen >= CHAIN:
            return start
    return None


def _row(data: bytes, at: int, header: _Header) -> tuple:
    size, ref, pos, name, _, _, cigar, flag, bases, *_ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    end, x = at + 4 + size, at + 36
    query = data[x : x + name - 1].decode()
    x += name
    used = covered = unlike = 0
    for op in struct.unpack_from(f"<{cigar}I", data, x):
        kind, n = _OPERATIONS[op & 15], op >> 4
        used += n * (kind in "MI=X")
        covered += n * (kind in "MDN=X")
        unlike += n * (kind == "X")
    x += 4 * cigar + (bases + 1) // 2 + bases
    nm = None
    while x < end:
        tag, kind = data[x : x + 2].decode(), chr(data[x + 2])
        x += 3
        if kind in "ZH":
            x = data.index(0, x) + 1
        elif kind == "B":
            x += 5 + _SIZES[chr(data[x])] * struct.unpack_from("<i", data, x + 1)[0]
        else:
            if kind in _NUMBERS and tag == "NM":
                nm = struct.unpack_from(_NUMBERS[kind], data, x)[0]
            x += _SIZES[kind]
    unmapped = bool(flag & 4)
    where = (None, None, None, None) if ref < 0 else (header.names[ref], pos, pos + covered, header.lengths[ref])
    return query, where[0], unmapped, not flag & 16, where[1], where[2], where[3], used, nm, unlike


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at), system.get_file_info(at).size


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


class _BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        file, size = _open(self.path)
        file.close()
        return [_Range(self.path, a, min(a + self.split, size)) for a in range(0, size, self.split)]

    def read(self, part: _Range) -> Iterator[tuple]:
        file, size = _open(part.path)
        with file:
            header = _header(file, size)
            start = 0 if part.start == 0 else _first_block(file, part.start, part.stop, size)
            if start is None:
                return
            data, own, closed = b"", 0, False  # bytes that are held, and how many of these are from blocks of this range
            blocks = _blocks(file, start, size)

            def more() -> bool:
                nonlocal data, own, closed
                found = next(blocks, None)
                if found is None:
                    return False
                data += found[1]
                if found[0] < part.stop:
                    own = len(data)
                else:
                    closed = True
                return True

            at: int | None = header.size if part.start == 0 else None
            skipped = 0
            while at is None:
                if not more():
                    at = _first_record(data, len(header.names)) if data else 0
                    break
                if len(data) >= 4 * BLOCK or closed:
                    at = _first_record(data, len(header.names))
            if at is None:
                return  # only the inside of a record that starts before
            while True:
                while len(data) < at + 4 and more():
                    pass
                if len(data) < at + 4:
                    return
                if at >= own and closed:
                    return
                n = 4 + struct.unpack_from("<i", data, at)[0]
                while len(data) < at + n:
                    if not more():
                        raise ValueError("the last record is cut off")
                if at >= own:
                    return
                yield _row(data, at, header)
                at += n
                if at >= 16 * BLOCK:  # what is read is dropped
                    data, own, skipped = data[at:], own - at, skipped + at
                    at = 0


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; the option ``splitBytes`` is the size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The records of a BAM file."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split).load(path)


def sam_records(lines: DataFrame) -> DataFrame:
    """The records of SAM lines, by built-in functions; references' lengths are those of the header's lines."""
    f = F.split("value", "\t")
    body = lines.filter(F.col("value").isNotNull() & ~F.startswith("value", F.lit("@"))).filter(F.size(f) >= 11)
    head = lines.filter(F.startswith("value", F.lit("@SQ\t")))
    lengths = head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("reference_name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("ref_length")).dropDuplicates(["reference_name"])
    flag, name = F.get(f, F.lit(1)).cast("int"), F.nullif(F.get(f, F.lit(2)), F.lit("*"))
    runs = lambda kinds: F.aggregate(F.regexp_extract_all(F.get(f, F.lit(5)), F.lit(rf"(\d+)[{kinds}]"), 1), F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:i:(-?\d+)", 1), F.lit("")).cast("bigint")
    start = F.when(name.isNotNull(), F.get(f, F.lit(3)).cast("bigint") - 1)
    rows = body.select(
        F.get(f, F.lit(0)).alias("query_name"), name.alias("reference_name"), (flag.bitwiseAND(4) != 0).alias("is_unmapped"), (flag.bitwiseAND(16) == 0).alias("is_forward"), start.alias("ref_start"),
        F.when(name.isNotNull(), start + runs("MDN=X")).alias("ref_end"), runs("MI=X").alias("query_alignment_length"), tag("NM").alias("nm"), runs("X").alias("mismatches"),
    )
    return rows.join(lengths, "reference_name", "left").select(*(c.split()[0] for c in SCHEMA.split(", ")))
