"""Percentiles of very large numeric columns from dyadic Count-sketches.

A value is encoded as an integer of :data:`BITS` bits that keeps the order: the binary exponent (:data:`OCTAVES` octaves)
and the leading :data:`MANTISSA` bits of the fraction. For each binary resolution of the codes there is one table of counters.
The coarse resolutions (at most ``WIDTH`` cells) hold exact counts, the finer ones a signed Count-sketch of :data:`DEPTH` rows: each cell
is hashed to one counter per row with a sign, and its count is the median of the signed counters. A sketch is an array of
integers; sketches of tasks, files or days are merged by addition, and a weight of -1 takes a value out again. A sketch of few
values is kept as the list of their codes and weights until it has more than :data:`LISTED`, so that many small groups cost what their
values do. A
percentile is found by descending from the coarsest resolution: at each level the rank goes left or right by the count of the
left half.

Error. Value: a reported value is the middle of its code's interval, within 2^-(MANTISSA+1) (0.05 %) of the true one
inside the octaves; smaller values count as zero, larger ones as the largest. Rank: the counts of the coarse levels are exact, so that
only the ``BITS - log2(WIDTH)`` finer levels add error; at each the count of one cell of the path is estimated with a standard
deviation of at most sqrt(F2 / WIDTH), F2 being the sum of the squared counts of that level's cells, and the count is kept
between 0 and that of its parent. The rank can never leave the exactly counted cell of 2^-9 of the octaves that holds it. README.md gives
the measured rank errors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the fraction kept, octaves covered, and the exponent of the smallest one.
MANTISSA, OCTAVES, LOWEST = 10, 64, -24
BITS = MANTISSA + 6
#: Counters of a row (a power of two), and rows of a sketch.
WIDTH, DEPTH = 512, 5
EXACT_BITS = 9
#: Bytes of sketches that a task holds before it hands them on, and values it gathers before adding them.
HELD_BYTES, GATHERED = 64 << 20, 262_144
#: Codes up to which a sketch is kept as a list of (code, weight).
LISTED = 1_024
#: Rows of a group that a task merges at first; their sums are merged in a second step.
SALTS = 32

_LEVELS = BITS - EXACT_BITS
#: Counters of one sketch: the exact counts of the EXACT_BITS leading bits, then the sketched levels, coarse to fine.
SIZE = WIDTH + _LEVELS * DEPTH * WIDTH
_ODD = np.random.default_rng(2013).integers(1, 2**62, (_LEVELS, DEPTH, 2), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of finite, non-negative values, in their order; 0 stands for zero and what is too small."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64) >> (52 - MANTISSA)
    return np.clip(bits - ((1023 + LOWEST) << MANTISSA), 0, 2**BITS - 1)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of each code's interval; 0 for code 0."""
    codes = np.asarray(codes, np.int64)
    low = ((codes + ((1023 + LOWEST) << MANTISSA)) << (52 - MANTISSA)).view(np.float64)
    high = ((codes + 1 + ((1023 + LOWEST) << MANTISSA)) << (52 - MANTISSA)).view(np.float64)
    return np.where(codes > 0, (low + high) / 2, 0.0)


def _place(level: int, row: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counter, sign) of each cell in a row of a sketched level."""
    multiplier, shift = _ODD[level, row]
    mixed = (cells.astype(np.uint64) + np.uint64(1)) * multiplier + shift
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - EXACT_BITS)).astype(np.int64), 1 - 2 * ((mixed >> np.uint64(20)) & np.uint64(1)).astype(np.int64)


def add(sketches: np.ndarray, group: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    """Add coded values to the sketches (one per row) of their groups."""
    n = len(sketches)
    # equal codes of a group first, as ties are common
    keys, at = np.unique(group * np.int64(2**BITS) + codes, return_inverse=True)
    weights = np.bincount(at.ravel(), weights=weights)
    group, codes = keys >> BITS, keys & (2**BITS - 1)
    sketches[:, :WIDTH] += np.bincount(group * WIDTH + (codes >> _LEVELS), weights=weights, minlength=n * WIDTH).reshape(n, -1).astype(np.int64)
    for level in range(_LEVELS):
        cells = codes >> (_LEVELS - 1 - level)
        for row in range(DEPTH):
            counter, sign = _place(level, row, cells)
            start = WIDTH * (1 + level * DEPTH + row)
            sums = np.bincount(group * WIDTH + counter, weights=weights * sign, minlength=n * WIDTH)
            sketches[:, start : start + WIDTH] += np.rint(sums).astype(np.int64).reshape(n, -1)


def count(sketch: np.ndarray, level: int, cell: int) -> float:
    """Estimated count of a cell of a sketched level."""
    found = []
    for row in range(DEPTH):
        counter, sign = _place(level, row, np.array([cell]))
        found.append(sign[0] * sketch[WIDTH * (1 + level * DEPTH + row) + counter[0]])
    return float(np.median(found))


def invert(sketch: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """The values at these ranks (from 1) of a sketch."""
    exact = np.cumsum(sketch[:WIDTH])
    out = []
    for rank in ranks:
        cell = int(np.searchsorted(exact, rank))
        left = rank - (exact[cell - 1] if cell else 0)
        held = float(sketch[cell])
        for level in range(_LEVELS):
            one, two = (count(sketch, level, 2 * cell + side) for side in (0, 1))
            # the two halves make up their parent: share out what the estimates leave over
            low = min(max((one + held - two) / 2, 0.0), held)
            if left <= low:
                cell, held = 2 * cell, low
            else:
                cell, left, held = 2 * cell + 1, left - low, held - low
        out.append(float(decode(np.array([cell]))[0]))
    return out


def _pack(sketch: np.ndarray) -> bytes:
    return b"\1" + pa.compress(sketch.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _pack_list(codes: np.ndarray, weights: np.ndarray) -> bytes:
    return b"\0" + np.stack([codes, weights]).astype(np.int64).tobytes()


class _Sum:
    """A sketch to which sketches and coded values are added."""

    def __init__(self) -> None:
        self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table: np.ndarray | None = None

    def put(self, codes: np.ndarray, weights: np.ndarray) -> None:
        """Add values; ``codes`` are distinct."""
        if self.table is None:
            codes, at = np.unique(np.r_[self.codes, codes], return_inverse=True)
            weights = np.rint(np.bincount(at.ravel(), np.r_[self.weights, weights], minlength=len(codes))).astype(np.int64)
            codes, weights = codes[weights != 0], weights[weights != 0]
            if len(codes) <= LISTED:
                self.codes, self.weights = codes, weights
                return
            self.table = np.zeros((1, SIZE), np.int64)
            self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        add(self.table, np.zeros(len(codes), np.int64), codes, weights.astype(np.float64))

    def put_packed(self, data: bytes) -> None:
        if data[:1] == b"\0":
            self.put(*np.frombuffer(data, np.int64, offset=1).reshape(2, -1))
            return
        other = np.frombuffer(pa.decompress(data[1:], SIZE * 8, codec="zstd", asbytes=True), np.int64)[None]
        if self.table is None:
            self.table = np.zeros((1, SIZE), np.int64)
            add(self.table, np.zeros(len(self.codes), np.int64), self.codes, self.weights.astype(np.float64))
            self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table += other

    def size(self) -> int:
        return 256 + 16 * len(self.codes) + (0 if self.table is None else self.table.nbytes)

    def n(self) -> int:
        return int(self.weights.sum() if self.table is None else self.table[0, :WIDTH].sum())

    def packed(self) -> bytes:
        return _pack_list(self.codes, self.weights) if self.table is None else _pack(self.table[0])

    def at(self, ranks: Sequence[int]) -> list[float]:
        """The values at these ranks (from 1); exact codes where they are listed."""
        if self.table is not None:
            return invert(self.table[0], ranks)
        ends = np.cumsum(self.weights)
        return [float(x) for x in decode(self.codes[np.minimum(np.searchsorted(ends, ranks), len(self.codes) - 1)])]


def sketches(rows: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Sketches of the finite, non-negative values of ``rows`` by ``keys``: keys, n, sketch (binary).

    Null, NaN, infinite and negative values are left out, whatever their number; a null key is a group of its own. A task gives one
    row or a few per group that it meets, to be combined by :func:`merged`: the aggregation's map side. It holds sketches of HELD_BYTES
    or little more, and hands them on before it takes up more groups. ``weight`` names a column of integers to add values with, -1 to take them
    out. An empty table gives no rows."""
    number = F.col(value).cast("double")
    kept = rows.where(number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf")))
    kept = kept.select(*keys, number.alias("value"), (F.col(weight).cast("int") if weight else F.lit(1)).alias("weight"))
    schema = kept.select(*keys).schema
    fields = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Sum] = {}
        filled = 0
        waiting: list[pa.RecordBatch] = []
        types: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            nonlocal filled
            filled = 0
            columns = [pa.array([name[i] for name in held], types[i]) for i in range(len(fields))]
            columns += [pa.array([x.n() for x in held.values()], pa.int64()), pa.array([x.packed() for x in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, [*fields, "n", "sketch"])

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal filled
            block = pa.Table.from_batches(waiting)
            waiting.clear()
            group = np.zeros(len(block), np.int64)
            codes = []
            for name in fields:  # one number per combination of keys
                part = block.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
                index = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                codes.append((index, part.dictionary.to_pylist()))
                group = np.unique(group * (len(part.dictionary) or 1) + index, return_inverse=True)[1].ravel()
            first = np.zeros(int(group.max()) + 1, np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]
            # equal codes of a group are one entry
            pairs, at = np.unique((group << BITS) | encode(block.column("value").to_numpy()), return_inverse=True)
            weights = np.rint(np.bincount(at.ravel(), block.column("weight").to_numpy().astype(np.float64))).astype(np.int64)
            edges = np.searchsorted(pairs, np.arange(len(first) + 1) << BITS)
            for g, i in enumerate(first):
                name = tuple(words[index[i]] for index, words in codes)
                if filled >= HELD_BYTES:
                    yield out()
                one = held.get(name)
                if one is None:
                    one = held[name] = _Sum()
                else:
                    filled -= one.size()
                one.put(pairs[edges[g] : edges[g + 1]] & (2**BITS - 1), weights[edges[g] : edges[g + 1]])
                filled += one.size()

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            types = [batch.schema.field(name).type for name in fields]
            size += len(batch)
            if size >= GATHERED:
                yield from take()
                size = 0
        if size:
            yield from take()
        if held:
            yield out()

    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return kept.mapInArrow(run, f"{declared}, n bigint, sketch binary")


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches added up by ``keys``: of tasks, days, files or tables.

    In two steps, first by SALTS parts of each group, so that no task holds all of a group's sketches."""
    fields = [f for f in parts.select(*keys).schema]
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def step(rows: DataFrame, by: list[str]) -> DataFrame:
        extra = [c for c in by if c not in keys]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total, done, types = None, None, [], []

            def out() -> pa.RecordBatch:
                columns = [pa.array([d[0][i] for d in done], t) for i, t in enumerate(types)]
                columns += [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.binary())]
                done.clear()
                return pa.RecordBatch.from_arrays(columns, [*by, "n", "sketch"])

            for batch in batches:  # sorted by key
                types = [batch.schema.field(c).type for c in by]
                for *own, data in zip(*[batch.column(c).to_pylist() for c in (*by, "sketch")]):
                    if total is None or own != key:
                        if total is not None:
                            done.append((key, total.n(), total.packed()))
                            if len(done) == 1_024:
                                yield out()
                        key, total = own, _Sum()
                    total.put_packed(data)
            if total is not None:
                done.append((key, total.n(), total.packed()))
                yield out()

        ordered = rows.repartition(*by).sortWithinPartitions(*by)
        return ordered.mapInArrow(run, f"{declared}, " + "".join(f"{c} int, " for c in extra) + "n bigint, sketch binary")

    salted = parts.select(*keys, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"), "sketch")
    return step(step(salted, [*keys, "_salt"]).select(*keys, "sketch"), list(keys))


def percentiles(parts: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles of merged sketches: ``keys``, n, and one column per entry of ``shares`` (name: share between 0 and 1).

    The percentile of share q is the value of rank ceil(q n), at least 1. Groups whose values were all taken out give null."""
    names, wanted = list(shares), list(shares.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("sketch").to_pylist():
                one = _Sum()
                one.put_packed(data)
                n = one.n()
                rows.append(one.at([max(1, int(np.ceil(q * n - 1e-9))) for q in wanted]) if n > 0 else [None] * len(wanted))
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(wanted))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("n"), *columns], [*keys, "n", *names])

    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema)
    return parts.mapInArrow(run, f"{declared}, n bigint, " + ", ".join(f"`{n}` double" for n in names))
