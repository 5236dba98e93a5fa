"""Counts of reads by position, in vectors: JVM rows are pieces of reads, not bases.

A piece lies in one bin of positions. Without mates each task sums its pieces by position and the sums are added up;
with mates pieces are dealt by bin and sorted by name, so that all reads of a name at a position meet in one task and
its counts are whole. What is shuffled grows with reads, never with bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergrid.functions import bases, cigar
from covergrid.operators.mates import FIRST_IN_PAIR, Strategy
from covergrid.schema import COUNTS

#: Positions per bin, as a power of two. Reads that span more are cut into pieces of one operation.
BIN_BITS = 11
BIN = 1 << BIN_BITS
#: Most bases that are expanded at a time, and most bins whose sums a task holds.
BASES, BINS = 1 << 20, 1024

# Operations by their number in packed CIGARs (length << 4 | number).
OPS = "MIDNSHP=X"
ON_REFERENCE, ON_QUERY, MATCH = (np.array([o in ops for o in OPS.ljust(16)]) for ops in (cigar.ON_REFERENCE, cigar.ON_QUERY, cigar.MATCHES))
CALLS = "ACGTNRYSWKM"
N = CALLS.index("N")
LETTER = np.full(256, N, np.uint8)
for _a, _b in zip("ACGTUacgtu", "ACGTTACGTT"):
    LETTER[ord(_a)] = CALLS.index(_b)
# What a base counts as: its call, or one of these; the last three count beside it.
DELETED, SKIPPED, FAILED, UNKNOWN, INSERTED, RESOLVED, MORE, WIDTH = 11, 12, 13, 14, 15, 16, 17, 18
NUMBERS = [*COUNTS, "raw"]
SCHEMA = "tid int, pos bigint, " + ", ".join(f"{c} bigint" for c in NUMBERS)


def _either_or(ambiguous_is_n: bool) -> np.ndarray:
    codes = {} if ambiguous_is_n else bases.AMBIGUITY
    return np.array([[CALLS.index(a if a == b else codes.get(min(a, b) + max(a, b), "N")) for b in "ACGTN"] for a in "ACGTN"], np.uint8)


def pieces(met: DataFrame, qualities: bool, mates: bool) -> DataFrame:
    """Reads clipped to [a, z) as rows of one bin: tid, bin, and from the bin's start lo, hi (what counts) and pos
    (where the CIGAR begins). Reads that span more than a bin are cut into operations, these at bins."""
    long = (F.col("span") > BIN).alias("long")
    number = lambda op: F.instr(F.lit(OPS), op) - 1
    pack = lambda n, op: F.shiftleft(n, 4).bitwiseOR(number(op))

    def bases_of(seq, at, n):
        """Of a sequence that ends too early at least an N, as bases it lacks are."""
        part = F.substring(seq, at, n)
        return F.when((F.octet_length(part) == 0) & (F.octet_length(seq) > 0), F.lit(b"N")).otherwise(part)

    quality = [F.col("qual").cast("array<smallint>").alias("qual")] if qualities else []
    whole = F.struct("pos", (F.col("pos") + F.col("span")).alias("end"), F.transform("cigar", lambda x: pack(x["len"], x["op"])).alias("ops"), "seq", *quality)

    def one(x):
        s = F.col("pos") + x["r"]
        part = [F.slice(F.col("qual").cast("array<smallint>"), (x["q"] + 1).cast("int"), x["len"]).alias("qual")] if qualities else []
        base = F.when(x["op"].isin(cigar.MATCHES), bases_of(F.col("seq"), (x["q"] + 1).cast("int"), x["len"])).otherwise(F.lit(b""))
        # What begins right after the last base stays behind it.
        ops = F.when(x["ins"], F.array(pack(x["len"], x["op"]), F.lit(OPS.index("I")))).otherwise(F.array(pack(x["len"], x["op"])))
        return F.struct(s.alias("pos"), (s + x["len"]).alias("end"), ops.alias("ops"), base.alias("seq"), *part)

    cut = F.transform(F.filter(cigar.steps(F.col("cigar")), lambda x: (F.col("pos") + x["r"] < F.col("z")) & (F.col("pos") + x["r"] + x["len"] > F.col("a"))), one)
    carried = ["tid", "pass", *(["mapq", "first", "ord", "qname"] if mates else [])]
    made = met.select(*carried, "a", "z", long, F.inline(F.when(F.col("span") > BIN, cut).otherwise(F.array(whole))))
    made = made.withColumns({"a": F.greatest("a", "pos"), "z": F.least("z", "end")}).filter("a < z")
    columns = ["pos", "end", "ops", "seq", *(["qual"] if qualities else [])]
    made = made.select(*carried, "a", "z", "long", *columns, F.explode(F.sequence(F.shiftright("a", BIN_BITS), F.shiftright(F.col("z") - 1, BIN_BITS))).alias("bin"))
    begin = F.shiftleft("bin", BIN_BITS)
    made = made.withColumns({"a": F.greatest(F.col("a"), begin), "z": F.least(F.col("z"), begin + BIN)})
    at, n, long = (F.col("a") - F.col("pos") + 1).cast("int"), (F.col("z") - F.col("a")).cast("int"), F.col("long")
    first = F.shiftleft(n, 4).bitwiseOR(F.get("ops", F.lit(0)).bitwiseAND(F.lit(15)))
    ops = F.when(F.col("z") == F.col("end"), F.concat(F.array(first), F.slice("ops", 2, 1))).otherwise(F.array(first))
    part = [F.when(long, F.slice("qual", at, n)).otherwise(F.col("qual")).alias("qual")] if qualities else []
    near = lambda c: (c - begin).cast("int")
    return made.select(
        *carried, "bin", near(F.col("a")).alias("lo"), near(F.col("z")).alias("hi"), near(F.when(long, F.col("a")).otherwise(F.col("pos"))).alias("pos"),
        F.when(long, ops).otherwise(F.col("ops")).alias("ops"), F.when(long, bases_of(F.col("seq"), at, n)).otherwise(F.col("seq")).alias("seq"), *part,
    )


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def _numbers(column: pa.Array, none: int = 0) -> np.ndarray:
    return pc.fill_null(column, none).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)


def _verdict(column: pa.Array) -> np.ndarray:
    """2 passes, 1 fails, 0 is null."""
    return pc.fill_null(pc.add(pc.cast(column, pa.int8()), pa.scalar(1, pa.int8())), 0).to_numpy(zero_copy_only=False)


class _Sums:
    """Counts of the bins at hand."""

    def __init__(self):
        self.slots: dict[int, int] = {}
        self.counts = np.zeros((0, BIN, WIDTH), np.uint32)
        self.added = 0

    def room(self, n: int, rows: int) -> bool:
        """Whether n more bins and that many bases surely fit."""
        return len(self.slots) + n <= BINS and self.added + rows < 1 << 32

    def slot(self, places: np.ndarray) -> np.ndarray:
        for p in places.tolist():
            self.slots.setdefault(p, len(self.slots))
        if len(self.slots) > len(self.counts):
            more = np.zeros((max(len(self.slots), min(2 * len(self.counts), BINS)), BIN, WIDTH), np.uint32)
            more[: len(self.counts)] = self.counts
            self.counts = more
        return np.array([self.slots[p] for p in places.tolist()], np.int64)

    def add(self, keys: np.ndarray, n=np.uint32(1)) -> None:
        np.add.at(self.counts.reshape(-1), keys, n)

    def _used(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions of a bin that have reads, and their counts."""
        c = self.counts[slot]
        at = np.flatnonzero(c.any(axis=1))
        return at, c[at]

    def packed(self) -> Iterator[pa.RecordBatch]:
        """(tid, bin, sums): each bin's positions, then its counts column by column, as narrow as they fit."""
        for place, slot in self.slots.items():
            at, c = self._used(slot)
            kind = np.min_scalar_type(int(c.max(initial=0)))
            sums = b"".join([bytes([kind.itemsize]), at.astype(np.uint16).tobytes(), c.T.astype(kind).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([place >> 40], pa.int32()), pa.array([place & ((1 << 40) - 1)]), pa.array([sums], pa.binary())], ["tid", "bin", "sums"])
        self.clear()

    def unpack(self, place: int, sums: bytes) -> None:
        size = sums[0]
        n = (len(sums) - 1) // (2 + WIDTH * size)
        at = np.frombuffer(sums, np.uint16, n, 1)
        slot = self.slot(np.array([place]))[0]
        self.counts[slot, at] += np.frombuffer(sums, f"u{size}", WIDTH * n, 1 + 2 * n).reshape(WIDTH, n).T

    def clear(self) -> None:
        self.counts[: len(self.slots)] = 0
        self.slots, self.added = {}, 0

    def flush(self, stays: int | None = None) -> Iterator[pa.RecordBatch]:
        """The rows of all bins but one."""
        for place, slot in self.slots.items():
            if place == stays:
                continue
            at, c = self._used(slot)
            c = c.astype(np.int64)
            tid, bin = place >> 40, place & ((1 << 40) - 1)
            numbers = [c[:, :SKIPPED].sum(axis=1), *(c[:, i] for i in range(len(CALLS))), c[:, INSERTED], c[:, DELETED], c[:, SKIPPED], c[:, FAILED], c[:, RESOLVED], c[:, :INSERTED].sum(axis=1) + c[:, MORE]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tid, np.int32)), pa.array(at + (bin << BIN_BITS)), *(pa.array(np.ascontiguousarray(x)) for x in numbers)], ["tid", "pos", *NUMBERS])
        kept = self.counts[self.slots[stays]].copy() if stays in self.slots else None
        self.clear()
        if kept is not None:
            self.counts[0] = kept
            self.slots = {stays: 0}


def _add(sums: _Sums, b: pa.RecordBatch, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray | None, strategy: Strategy | None, min_base_quality: int | None) -> None:
    """Counts the bases of the rows' [lo, hi). ``group`` numbers the names in their order, for mates."""
    bins, of = np.unique(place, return_inverse=True)
    begin = sums.slot(bins)[of] * BIN
    passes, pos = _verdict(b["pass"]), _numbers(b["pos"])
    offsets, packed = b["ops"].offsets.to_numpy().astype(np.int64), b["ops"].values.to_numpy(zero_copy_only=False)
    packed = packed[offsets[0] : offsets[-1]]
    read = np.repeat(np.arange(len(pos)), np.diff(offsets))
    number, length = packed & 15, (packed >> 4).astype(np.int64)
    head = np.cumsum(np.diff(offsets)) - np.diff(offsets)
    running = lambda x: (np.cumsum(x) - x)
    r, q = running(length * ON_REFERENCE[number]), running(length * ON_QUERY[number])
    at = np.minimum(head, max(len(r) - 1, 0))
    s, q = pos[read] + r - r[at][read], q - q[at][read]
    e = s + length
    inserted = np.zeros(len(read), bool)
    inserted[:-1] = (number[1:] == OPS.index("I")) & (read[1:] == read[:-1])
    inserted &= MATCH[number]
    a, z = np.maximum(s, lo[read]), np.minimum(e, hi[read])
    some = np.flatnonzero(ON_REFERENCE[number] & (a < z))
    read, number, s, e, q, a, z, inserted = (x[some] for x in (read, number, s, e, q, a, z, inserted))
    if not len(read):
        return
    # From operations to bases.
    n = z - a
    ends = np.cumsum(n)
    step = np.repeat(np.arange(len(n)), n)
    p = np.arange(ends[-1]) + (a - ends + n)[step]
    sums.added += len(p)
    seq_at, seq = _binary(b["seq"])
    size = np.diff(seq_at)
    match = MATCH[number]
    has = match & (size[read] > 0)
    i = p + (seq_at[read] + q - s)[step]
    letter = LETTER[seq[np.minimum(i, len(seq) - 1)]]
    short = has & (q + z - s > size[read])
    if short.any():
        letter[short[step] & (i >= seq_at[1:][read][step])] = N
    fixed = np.where(passes[read] == 0, UNKNOWN, np.where(passes[read] == 1, FAILED, np.where(match, np.where(has, 255, N), np.where(number == OPS.index("D"), DELETED, SKIPPED)))).astype(np.uint8)
    fixed_here = fixed[step]
    code = np.where(fixed_here == 255, letter, fixed_here)
    bq = None
    if "qual" in b.schema.names:
        qual_at, qual = b["qual"].offsets.to_numpy().astype(np.int64), _numbers(b["qual"].values, 255)
        j = p + (qual_at[:-1][read] + q - s)[step]
        inside = j < qual_at[1:][read][step]
        bq = np.where(inside, qual[np.minimum(j, len(qual) - 1)], 255).astype(np.int64) if len(qual) else np.full(len(p), 255)
    key = (begin[read][step] + p) * WIDTH
    kept, best = None, None
    if strategy is not None:
        kept, best, chosen, also = _resolved(b, read, step, p, group, lo, hi, passes, has, letter, bq, strategy)
        if best is not None and strategy.tie is not None:
            ok = (also >= 0) & (code[best] < UNKNOWN)
            called = np.where(ok, also, code[best]).astype(np.uint8)
            code[best] = called
    if min_base_quality is not None:
        counted = (passes[read] == 2) & match
        masked = counted[step] & (~has[step] | (bq < min_base_quality if bq is not None else False))
        code[masked] = N
    last = ends - 1
    ins = last[inserted & (z == e) & (passes[read] == 2)]
    if kept is not None:
        ins = ins[kept[ins]]
        sums.add(key[best] + MORE, (chosen - 1).astype(np.uint32))
        sums.add(key[best[passes[read[step[best]]] == 2]] + RESOLVED)
        key_all = key[kept] + code[kept]
    else:
        key_all = key + code
    sums.add(key_all)
    sums.add(key[ins] + INSERTED)


def _resolved(b, read, step, p, group, lo, hi, passes, has, letter, bq, strategy):
    """Of the reads of a name at a position one stays: which bases stay, of those the ones that were chosen from
    several, from how many, and the base recommended (-1: none)."""
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low, high = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
    extent = np.maximum(high - low, 0).astype(np.int64)
    origin = np.cumsum(extent) - extent - low
    cell = origin[group[read]][step] + p
    several = np.bincount(cell, minlength=int(extent.sum()))
    sub = np.flatnonzero(several[cell] >= 2)
    kept = np.ones(len(p), bool)
    if not len(sub):
        return None, None, None, None
    kept[sub] = False
    where, rows, has_base = cell[sub], read[step[sub]], has[step[sub]]
    paired = (np.bincount(where[has_base], minlength=len(several)) == several)[where]
    mapq, known = _numbers(b["mapq"], -(1 << 31)).astype(np.int64)[rows], b["mapq"].is_valid().to_numpy(zero_copy_only=False)[rows]
    first = _numbers(b["first"]).astype(np.int64)[rows]
    nil = np.zeros(len(sub), np.int64)
    quality = nil if bq is None else np.where(has_base, bq[sub], -1)
    own = [{"bq": quality, "mapq": mapq}[k] for k in strategy.keys] + ([first] if strategy.first else [])
    fallback = [mapq, first]
    if strategy is Strategy.ORIGINAL:
        keys = fallback
    else:
        wide = max(len(own), len(fallback))
        own, fallback = own + [nil] * (wide - len(own)), fallback + [nil] * (wide - len(fallback))
        keys = [np.where(paired, x, y) for x, y in zip(own, fallback)]
    rank = np.empty(len(lo), np.int64)
    rank[np.argsort(_numbers(b["ord"]), kind="stable")] = np.arange(len(lo))
    order = _order(where, [passes[rows].astype(np.int64), *keys], rank[rows])
    sorted_cells = where[order]
    top = np.flatnonzero(np.concatenate([[True], sorted_cells[1:] != sorted_cells[:-1]]))
    one, two = order[top], order[top + 1]
    best = sub[one]
    kept[best] = True
    recommended = np.full(len(best), -1, np.int64)
    if strategy.tie is not None:
        met = (passes[rows[one]] == 2) & (passes[rows[two]] == 2) & paired[one]
        if strategy.keys:
            met &= (quality[one] == quality[two]) & (mapq[one] == mapq[two]) & known[one] & known[two]
        x, y = letter[best], letter[sub[two]]
        recommended[met] = _either_or(strategy.tie == "n")[x[met], y[met]]
    return kept, best, several[where[one]], recommended


def _order(cell: np.ndarray, keys: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
    """Cells in their order, in each the greatest keys first, then the least rank."""
    parts = [cell, *(k.max() - k for k in keys), rank]
    bits = [int(x.max()).bit_length() for x in parts]
    if sum(bits) > 63:
        return np.lexsort(parts[::-1])
    packed = np.zeros(len(cell), np.int64)
    for x, n in zip(parts, bits):
        packed = (packed << n) | x
    return np.argsort(packed)


def _parts(place: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BASES bases and a quarter of BINS bins."""
    much = np.cumsum(n)
    fresh = np.cumsum(np.concatenate([[1], (place[1:] != place[:-1]).astype(np.int64)]))
    a = 0
    while a < len(n):
        before, bins = (much[a - 1] if a else 0), fresh[a]
        z = min(int(np.searchsorted(much, before + BASES, "right")), int(np.searchsorted(fresh, bins + BINS // 4, "left")))
        z = max(z, a + 1)
        yield a, z
        a = z


def _place(b: pa.RecordBatch) -> np.ndarray:
    return (_numbers(b["tid"]).astype(np.int64) << 40) + _numbers(b["bin"]).astype(np.int64)


def summed(min_base_quality: int | None):
    """Packed counts of a task's pieces, which come in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            if not b.num_rows:
                continue
            place = _place(b)
            if len(np.unique(place)) > BINS // 4:
                order = np.argsort(place, kind="stable")
                b, place = b.take(pa.array(order)), place[order]
            lo, hi = _numbers(b["lo"]), _numbers(b["hi"])
            for a, z in _parts(np.zeros_like(place) if len(np.unique(place)) <= BINS // 4 else place, hi - lo):
                if not sums.room(len(set(place[a:z].tolist()) - sums.slots.keys()), int((hi - lo)[a:z].sum())):
                    yield from sums.packed()
                _add(sums, b.slice(a, z - a), place[a:z], lo[a:z], hi[a:z], None, None, min_base_quality)
        yield from sums.packed()

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts from packed ones that are sorted by (tid, bin)."""
    sums = _Sums()
    for b in batches:
        for place, packed in zip(_place(b).tolist(), b["sums"]):
            if place not in sums.slots:
                yield from sums.flush()
            sums.unpack(place, packed.as_py())
    yield from sums.flush()


def resolved(strategy: Strategy, min_base_quality: int | None):
    """Counts of pieces that are sorted by (tid, bin, qname, lo), each position once. Where a name's reads go on
    beyond a batch, positions from the last read's start wait for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = _Sums(), None

        def add(b: pa.RecordBatch, final: bool) -> pa.RecordBatch | None:
            place, lo, hi, name = _place(b), _numbers(b["lo"]), _numbers(b["hi"]), b["qname"]
            one, two = name.slice(0, len(name) - 1), name.slice(1)
            same = pc.fill_null(pc.equal(one, two), False).to_numpy(zero_copy_only=False) | (one.is_null().to_numpy(zero_copy_only=False) & two.is_null().to_numpy(zero_copy_only=False))
            group = np.concatenate([[0], np.cumsum(~same | (place[1:] != place[:-1]))]).astype(np.int64)
            rest = None
            if not final:
                cut = lo[-1]
                tail = np.flatnonzero((group == group[-1]) & (hi > cut))
                rest = b.take(pa.array(tail))
                rest = rest.set_column(rest.schema.get_field_index("lo"), "lo", pa.array(np.maximum(lo[tail], cut), pa.int32()))
                hi = np.where(group == group[-1], np.minimum(hi, cut), hi)
            _add(sums, b, place, lo, hi, group, strategy, min_base_quality)
            return rest

        for b in batches:
            if not b.num_rows:
                continue
            place, n = _place(b), _numbers(b["hi"]) - _numbers(b["lo"])
            for a, z in _parts(place, n):
                part = b.slice(a, z - a)
                part = part if held is None else pa.concat_batches([held.cast(part.schema), part])
                held = add(part, False)
                if len(sums.slots) > 1 or not sums.room(0, 4 * BASES):
                    yield from sums.flush(int(place[z - 1]))
        if held is not None:
            add(held, True)
        yield from sums.flush()

    return run


def counts(met: DataFrame, strategy: Strategy | None, min_base_quality: int | None) -> DataFrame:
    """(tid, pos, counts, raw) of reads clipped to disjoint [a, z), each position once."""
    qualities = min_base_quality is not None or (strategy is not None and "bq" in strategy.keys)
    made = pieces(met, qualities, strategy is not None)
    if strategy is None:
        some = made.mapInArrow(summed(min_base_quality), "tid int, bin bigint, sums binary")
        return some.repartition("tid", "bin").sortWithinPartitions("tid", "bin").mapInArrow(added, SCHEMA)
    dealt = made.repartition("tid", "bin").sortWithinPartitions("tid", "bin", "qname", "lo")
    return dealt.mapInArrow(resolved(strategy, min_base_quality), SCHEMA)
