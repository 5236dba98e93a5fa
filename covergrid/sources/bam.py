"""BAM files: a reader whose tasks start at the record boundaries that the index knows.

With an index (.bai or .csi) beside it, a file is dealt out in ranges of virtual offsets, each starting at a
record that the index points to, and for given regions only those ranges are read that the index has for them;
without one, a file is one range. Every task reads one range, some megabytes at a time, and takes the records'
fields out of the bytes by columns.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from covergrid.schema import READS

#: Compressed bytes that a task should read.
SPLIT_BYTES = 16 << 20
# Fixed values of the format: base codes and CIGAR operation codes.
SEQ_CODES = "=ACMGRSVTWYHKDBN"
CIGAR_CODES = "MIDNSHP=X"
#: Bytes that are decoded at a time.
AT_ONCE = 4 << 20


def open_file(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))
    return fs.open_input_file(path)


class Blocks:
    """A block-gzipped file as a stream of bytes, with virtual offsets."""

    def __init__(self, file, offset: int = 0):
        self.file, self.at, self.data, self.pos, self.next = file, 0, b"", 0, offset >> 16
        if offset:
            self._block()
            self.pos = offset & 0xFFFF

    def _block(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            self.at, self.data, self.pos = self.next, b"", 0
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:18] + self.file.read(extra - 6)
        size, i = None, 0
        while i < extra:
            tag, n = fields[i : i + 2], struct.unpack_from("<H", fields, i + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", fields, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError("not a block-gzipped file")
        body = self.file.read(size - 12 - extra)
        self.at, self.pos = self.next, 0
        self.data = zlib.decompress(body[:-8], -15)
        self.next += size
        return True

    def tell(self) -> int:
        return self.next << 16 if self.pos >= len(self.data) else self.at << 16 | self.pos

    def rest(self) -> bytes:
        """What is left of the block, or the next one that isn't empty; nothing at the end of the file."""
        while self.pos >= len(self.data):
            if not self._block():
                return b""
        out, self.pos = self.data[self.pos :], len(self.data)
        return out

    def read(self, n: int) -> bytes:
        """n bytes; fewer at the end of the file."""
        out = self.data[self.pos : self.pos + n]
        self.pos += len(out)
        while len(out) < n and self._block():
            more = self.data[: n - len(out)]
            self.pos = len(more)
            out += more
        return out


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """Reads up to the first record; the contigs' names and lengths."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


# ---- records ------------------------------------------------------------------------------------

_LETTERS = np.frombuffer(SEQ_CODES.encode(), np.uint8)
# Fixed values of the format: bytes of a tag's value, by its type.
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def _flat(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the runs that start there, one after the other, and each one's place in its run."""
    ends = np.cumsum(sizes)
    within = np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - sizes, sizes)
    return np.repeat(starts, sizes) + within, within


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _strings(data: np.ndarray, sizes: np.ndarray, empty_is_null: bool = False) -> pa.Array:
    bits = pa.py_buffer(np.packbits(sizes > 0, bitorder="little")) if empty_is_null else None
    return pa.StringArray.from_buffers(sizes.size, _offsets(sizes).buffers()[1], pa.py_buffer(np.ascontiguousarray(data)), bits)


def _long_cigar(tags: bytes) -> np.ndarray | None:
    """The operations in a record's CG tag: there where they are too many for its CIGAR."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            n = struct.unpack_from("<i", tags, at + 1)[0]
            if name == b"CG":
                return np.frombuffer(tags, "<u4", n, at + 5)
            at += 5 + n * _TAG_SIZES[chr(tags[at])]
        else:
            at += _TAG_SIZES[kind]
    return None


def decode(data: bytes, at: np.ndarray, orders: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The records that start at these places, as columns of READS."""
    raw = np.frombuffer(data, np.uint8)
    f = np.ascontiguousarray(raw[at[:, None] + np.arange(36)]).view("<i4").reshape(-1, 9)
    tid, pos, n_seq, mate_tid, mate_pos, tlen = (f[:, i] for i in (1, 2, 5, 6, 7, 8))
    n_name, mapq, n_cigar, flag = f[:, 3] & 0xFF, f[:, 3] >> 8 & 0xFF, f[:, 4] & 0xFFFF, f[:, 4] >> 16 & 0xFFFF
    starts = at + 36
    qname = _strings(raw[_flat(starts, n_name - 1)[0]], n_name - 1)
    starts = starts + n_name
    ops = np.ascontiguousarray(raw[_flat(starts, 4 * n_cigar)[0]]).view("<u4")
    seq_at = starts + 4 * n_cigar
    n_packed = (n_seq + 1) // 2
    _, j = _flat(seq_at, n_seq)
    byte = raw[np.repeat(seq_at, n_seq) + (j >> 1)]
    letters = _LETTERS[np.where(j & 1, byte & 15, byte >> 4)]
    qual_at = seq_at + n_packed
    qual = raw[_flat(qual_at, n_seq)[0]].astype(np.int32)
    first = np.cumsum(n_cigar) - n_cigar
    two = np.flatnonzero(n_cigar == 2)
    held = two[(ops[first[two]] == (n_seq[two] << 4 | 4).astype(np.uint32)) & (ops[first[two] + 1] & 15 == 3)]
    if held.size:  # stand-ins for CIGARs that are kept in a tag
        parts, n_cigar = np.split(ops, first[1:]), n_cigar.copy()
        for i in held.tolist():
            found = _long_cigar(data[qual_at[i] + n_seq[i] : at[i] + 4 + f[i, 0]])
            if found is not None:
                parts[i], n_cigar[i] = found, found.size
        ops = np.concatenate(parts)
    kinds = pa.array(list(CIGAR_CODES)).take(pa.array((ops & 15).astype(np.int32)))
    steps = pa.StructArray.from_arrays([pa.array((ops >> 4).astype(np.int32)), kinds], ["len", "op"])
    ref = pa.array(names, pa.string()).take(pa.array(tid, mask=tid < 0))
    int64 = lambda x: pa.array(x.astype(np.int64))
    columns = {
        "qname": qname, "flag": pa.array(flag), "tid": pa.array(tid), "ref": ref, "pos": int64(pos), "mapq": pa.array(mapq), "cigar": pa.ListArray.from_arrays(_offsets(n_cigar), steps),
        "mate_tid": pa.array(mate_tid), "mate_pos": int64(mate_pos), "tlen": int64(tlen), "seq": _strings(letters, n_seq, True),
        "qual": pa.ListArray.from_arrays(_offsets(n_seq), pa.array(qual)), "ord": pa.array(orders),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_range(blocks: Blocks, stop: int, names: list[str], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The records from where blocks stands up to the virtual offset stop."""
    held, places = b"", []  # bytes not decoded yet; (place in held, virtual offset) of the parts of blocks in it
    more = True
    while more:
        parts, n = [held], len(held)
        # To the end of the block that stop lies in; from there on block by block, until the last record is whole.
        while n == len(held) or (n < len(held) + at_once and blocks.next << 16 <= stop):
            part = blocks.rest()
            if not part:
                more = False
                break
            places.append((n, (blocks.at << 16) + len(blocks.data) - len(part)))
            parts.append(part)
            n += len(part)
        held = b"".join(parts)
        found, i = [], 0
        while i + 4 <= len(held) and (end := i + 4 + int.from_bytes(held[i : i + 4], "little")) <= len(held):
            found.append(i)
            i = end
        if found:
            at, (begin, offset) = np.array(found), map(np.array, zip(*places, strict=True))
            k = np.searchsorted(begin, at, side="right") - 1
            orders = offset[k] + at - begin[k]
            keep = orders < stop
            if keep.any():
                yield decode(held, at[keep], orders[keep], names)
            if not keep.all():
                return
        if not more and i < len(held) and places and _offset(places, i) < stop:
            raise ValueError("the file is cut short")
        last = max((k for k, (b, _) in enumerate(places) if b <= i), default=None)
        held, places = held[i:], [] if last is None else [(b - i, o) for b, o in places[last:]]


def _offset(places: list[tuple[int, int]], i: int) -> int:
    begin, offset = max(p for p in places if p[0] <= i)
    return offset + i - begin


# ---- index --------------------------------------------------------------------------------------


class Index:
    """A .bai or .csi file: for each contig the chunks (virtual offsets) of its bins, and the smallest
    offsets that matter from a position on."""

    def __init__(self, data: bytes):
        if data[:2] == b"\x1f\x8b":
            data = _inflated(data)
        if data[:4] not in (b"BAI\1", b"CSI\1"):
            raise ValueError("not a BAM index")
        self.csi, at = data[:4] == b"CSI\1", 4
        self.shift, self.depth = 14, 5
        if self.csi:
            self.shift, self.depth, aux = struct.unpack_from("<3i", data, at)
            at += 12 + aux
        n_ref, at = struct.unpack_from("<i", data, at)[0], at + 4
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.least: list[dict[int, int] | list[int]] = []
        for _ in range(n_ref):
            bins, least = {}, {}
            n_bin, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n_bin):
                number, at = struct.unpack_from("<I", data, at)[0], at + 4
                if self.csi:
                    least[number], at = struct.unpack_from("<Q", data, at)[0], at + 8
                n, at = struct.unpack_from("<i", data, at)[0], at + 4
                flat = struct.unpack_from(f"<{2 * n}Q", data, at)
                at += 16 * n
                if number < ((1 << 3 * (self.depth + 1)) - 1) // 7:  # beyond: counts, not places
                    bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            if not self.csi:
                n, at = struct.unpack_from("<i", data, at)[0], at + 4
                least = list(struct.unpack_from(f"<{n}Q", data, at))
                at += 8 * n
            self.bins.append(bins)
            self.least.append(least)

    def points(self) -> list[int]:
        """Virtual offsets at which records start."""
        out = {a for bins in self.bins for chunks in bins.values() for a, _ in chunks}
        if not self.csi:
            out.update(x for least in self.least for x in least)
        return sorted(out - {0})

    def chunks(self, tid: int, start: int, stop: int) -> list[tuple[int, int]]:
        """Where the records that overlap the region are, and others."""
        if not 0 <= tid < len(self.bins) or start >= stop:
            return []
        bins, least, out = self.bins[tid], self.least[tid], []
        if not self.csi:
            first = least[min(start >> 14, len(least) - 1)] if least else 0
        else:
            leaf = ((1 << 3 * self.depth) - 1) // 7 + (start >> self.shift)
            while leaf and leaf not in least:
                leaf = (leaf - 1) >> 3
            first = least.get(leaf, 0)
        spans = [(((1 << 3 * k) - 1) // 7, self.shift + 3 * (self.depth - k)) for k in range(self.depth + 1)]
        for number, chunks in bins.items():
            base, shift = next(x for x in reversed(spans) if number >= x[0])
            if start >> shift <= number - base <= (stop - 1) >> shift:
                out += [(max(a, first), z) for a, z in chunks if z > first]
        return out


def _inflated(data: bytes) -> bytes:
    out = b""
    while data:
        unpack = zlib.decompressobj(31)
        out += unpack.decompress(data)
        data = unpack.unused_data
    return out


def _index(path: str) -> Index | None:
    stem = path.removesuffix(".bam")
    for name in (f"{path}.bai", f"{stem}.bai", f"{path}.csi", f"{stem}.csi"):
        try:
            with open_file(name) as f:
                return Index(f.read())
        except FileNotFoundError:
            continue
    return None


def ranges(path: str, split: int, regions: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """Ranges of virtual offsets to read, of about split compressed bytes each: the whole file, or what the index
    has for the regions (tid, start, stop)."""
    with open_file(path) as f:
        blocks = Blocks(f)
        header(blocks)
        wanted = [(blocks.tell(), (1 << 63) - 1)]
    index = _index(path)
    if index is None:
        return wanted
    if regions is not None:
        wanted = []
        for a, z in sorted(c for r in regions for c in index.chunks(*r)):
            if wanted and a <= wanted[-1][1]:
                wanted[-1] = (wanted[-1][0], max(wanted[-1][1], z))
            else:
                wanted.append((a, z))
    out, points = [], index.points()
    for a, z in wanted:
        for p in points[bisect_right(points, a) : bisect_left(points, z)]:
            if (p >> 16) - (a >> 16) >= split:
                out.append((a, p))
                a = p
        out.append((a, z))
    return out


# ---- Spark --------------------------------------------------------------------------------------


def contigs(spark: SparkSession, path: str) -> DataFrame:
    with open_file(path) as f:
        names = header(Blocks(f))
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(names)], "tid int, ref string, length bigint")


def reads(spark: SparkSession, path: str, split: int = SPLIT_BYTES, regions: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """The records of a BAM file as READS; ord is a record's virtual offset. With regions (tid, start, stop)
    and an index, those that overlap them, each once, and some of their neighbours."""
    todo = ranges(path, split, regions)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in b.column(0).to_pylist():
                start, stop = todo[i]
                with open_file(path) as f:
                    names = [n for n, _ in header(Blocks(f))]
                    yield from read_range(Blocks(f, start), stop, names)

    # One range a task.
    return spark.range(0, len(todo), 1, max(1, len(todo))).mapInArrow(batches, READS)
