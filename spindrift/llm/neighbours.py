"""The k most similar vectors for every vector, by an inverted multi-index.

Vectors are grouped by a ``collection``; similarity is the cosine. Rows whose vector is unsound (null, not ``width``
wide, a NaN or infinite value, all zero) or whose id or collection is null are left out: they are no vectors.

Method. Each collection has one index. The two halves of its vectors are quantised separately (k-means on a bounded sample, see
:data:`SAMPLE_ROWS`), and every vector is entered in the cell of its pair of centroids. For each query a heap yields the centroid pairs by
the sum of the two distances, until the cells hold :func:`scan_target` entries, and these are reranked by the full inner product. A collection of
at most :data:`SCAN_ROWS` vectors is one cell.

The cells are put together, in their order, to regions of about :data:`REGION_ROWS` entries, the unit of the shuffle: an entry goes to its
region, a query to the regions of its cells only, with the list of these cells. A cell that is larger than a region is cut into slices by a hash of
the id, and a region with many queries answers them in blocks of :data:`BLOCK_ROWS`, so that neither a hot collection nor a hot cell meets in one
task. The answers of the regions are merged by rank. Codebooks and counts of cells go to every task while all together have at most
:data:`HEADER_BYTES`; beyond, they travel beside the rows of their collection as one row per block. Copies of a vector are scored once and expanded again.

Accuracy. What is lost are neighbours in cells beyond the scan target; ``exact`` scans all. README.md gives the recall measured against
brute force. Similarities are exact (float32 products of unit vectors)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.runtime import cut, small

#: Entries of a region, most queries of one block (about 256 bytes each in memory, a few times over).
REGION_ROWS, BLOCK_ROWS = 131_072, 65_536
#: Vectors of a collection that its codebooks are fitted on, at most; the index holds all of them.
SAMPLE_ROWS = 8_192
#: Entries scanned for a query in a collection of at most that many vectors; beyond, the target grows as a power of the collection.
SCAN_ROWS, SCAN_POWER = 8_192, 2 / 3
#: Bytes of codebooks and counts of cells up to which they go to every task; beyond, they are joined to the rows by a shuffle.
HEADER_BYTES = 32 << 20
#: Entries of a cell on average, and most centroids of a half.
CELL_ROWS, MOST_CENTROIDS = 256, 256


def centroids_of(rows: int, scan: int | None = None, per_cell: int | None = None) -> int:
    """Centroids of each half for a collection of ``rows`` vectors."""
    if rows <= (scan or SCAN_ROWS):
        return 1
    return int(np.clip(round((rows / (per_cell or CELL_ROWS)) ** 0.5), 2, MOST_CENTROIDS))


def scan_target(rows: int) -> int:
    """Entries gathered for each query from a collection of ``rows`` vectors."""
    return int(SCAN_ROWS * max(1.0, rows / SCAN_ROWS) ** SCAN_POWER)


# ---- sound unit vectors -------------------------------------------------------------------------------------------


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A binary column of ``width`` float32 values as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * x.shape[1]
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(x.tobytes())])


def unit_vectors(rows: DataFrame, vector: str = "vector", width: int = 64) -> DataFrame:
    """``rows`` with sound vectors only, the column ``vector`` replaced by ``unit``: the vector divided by its norm,
    as binary float32, which is smaller than an array and read without copying."""
    rest = [c for c in rows.columns if c != vector]
    kept = rows.where(F.size(vector) == width).select(*rest, F.col(vector).alias("unit"))

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("unit")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            with np.errstate(all="ignore"):
                norm = np.sqrt((values * values).sum(1))
                # a finite norm rules out NaN and infinity, save for squares that overflow
                big = np.abs(values).max(1, initial=0)
                again = np.isfinite(values).all(1) & (~np.isfinite(norm) | (norm == 0)) & (big > 0)
                values[again] /= big[again, None]
                norm[again] = np.sqrt((values[again] ** 2).sum(1))
                sound = np.isfinite(norm) & (norm > 0)
            units = (values[sound] / norm[sound, None]).astype(np.float32)
            picked = batch.filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([*[picked.column(c) for c in rest], packed(units)], [*rest, "unit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "unit")
    return kept.mapInArrow(normalise, f"{schema}, unit binary")


# ---- the index of one shard ---------------------------------------------------------------------------------------


def codebook(x: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of ``x`` by k-means from a fixed seed."""
    pick = np.random.default_rng(7).choice(len(x), size, replace=len(x) < size)
    centres = x[pick].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=size)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(count[filled])[:-1]])
        centres[filled] = sums / count[filled, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def closest_cells(first: list[float], second: list[float], by_first: list[int], by_second: list[int], counts: list[int], target: int) -> list[int]:
    """Numbers of the non-empty cells with the smallest ``first[i] + second[j]`` that hold ``target`` entries together.

    ``first`` and ``second`` are the sorted distances to the centroids of the halves, ``by_first`` and ``by_second`` these centroids.
    Multi-sequence traversal: from each pair of ranks taken off the heap, the next rank of the second half is put on,
    and from the first of a row also the next row, so that every pair is met once, in the order of its sum."""
    size = len(first)
    heap, cells, total = [(first[0] + second[0], 0, 0)], [], 0
    while heap and total < target:
        _, i, j = heapq.heappop(heap)
        cell = by_first[i] * size + by_second[j]
        if counts[cell]:
            cells.append(cell)
            total += counts[cell]
        if j + 1 < size:
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < size:
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
    return cells


def traversals(queries: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray, target: int) -> list[list[int]]:
    """The cells that each query is answered from, nearest first."""
    half, held = left.shape[1], counts.tolist()
    if len(left) == 1:
        return [[0]] * len(queries)
    sides = []
    for centres, part in ((left, queries[:, :half]), (right, queries[:, half:])):
        far = (centres * centres).sum(1) - 2 * part @ centres.T
        order = np.argsort(far, axis=1, kind="stable")
        sides.append((np.take_along_axis(far, order, axis=1).tolist(), order.tolist()))
    return [closest_cells(a, b, i, j, held, target) for a, i, b, j in zip(*sides[0], *sides[1])]


def best_in_cells(units: np.ndarray, cell: np.ndarray, queries: np.ndarray, cells: list[list[int]], k: int, at_least: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows of ``units`` in its cells with the largest inner products, best first, and these products.
    Places that stay empty hold -1 and minus infinity; products below ``at_least`` may be left out."""
    found, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
    if not len(units) or not len(queries):
        return found, scores
    order = np.argsort(cell, kind="stable")
    names, begin = np.unique(cell[order], return_index=True)
    end = np.r_[begin[1:], len(order)]
    asked = np.repeat(np.arange(len(queries)), [len(c) for c in cells])
    wanted = np.concatenate([np.asarray(c, np.int64) for c in cells]) if len(asked) else np.zeros(0, np.int64)
    by_cell = np.argsort(wanted, kind="stable")
    low, high = np.searchsorted(wanted[by_cell], names, "left"), np.searchsorted(wanted[by_cell], names, "right")
    for a, b, x, y in zip(begin, end, low, high):
        entries, members = order[a:b], asked[by_cell[x:y]]
        held = units[entries]
        for at in range(0, len(members), 256):
            part = members[at : at + 256]
            product = queries[part] @ held.T
            useful = product.max(1) > np.maximum(scores[part, -1], at_least - 1e-6)
            part, product = part[useful], product[useful]
            if not len(part):
                continue
            best = best_columns(product, k)
            values = np.concatenate([scores[part], np.take_along_axis(product, best, axis=1)], axis=1)
            rows = np.concatenate([found[part], entries[best]], axis=1)
            top = np.argpartition(-values, k - 1, axis=1)[:, :k] if values.shape[1] > k else np.tile(np.arange(values.shape[1]), (len(part), 1))
            values, rows = np.take_along_axis(values, top, axis=1), np.take_along_axis(rows, top, axis=1)
            sort = np.argsort(-values, axis=1, kind="stable")
            scores[part], found[part] = np.take_along_axis(values, sort, axis=1), np.take_along_axis(rows, sort, axis=1)
    return found, scores


def best_columns(scores: np.ndarray, k: int, span: int = 16) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row, in no order. The largest lie in the spans with the largest maxima."""
    rows, width = scores.shape
    if width <= k:
        return np.tile(np.arange(width), (rows, 1))
    if width <= 2 * k * span:
        return np.argpartition(-scores, k - 1, axis=1)[:, :k]
    whole = width // span * span
    tops = scores[:, :whole].reshape(rows, -1, span).max(2)
    spans = np.argpartition(-tops, k - 1, axis=1)[:, :k]
    columns = (spans[:, :, None] * span + np.arange(span)).reshape(rows, -1)
    if whole < width:
        columns = np.concatenate([columns, np.tile(np.arange(whole, width), (rows, 1))], axis=1)
    values = np.take_along_axis(scores, columns, axis=1)
    return np.take_along_axis(columns, np.argpartition(-values, k - 1, axis=1)[:, :k], axis=1)


def fit(sample: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks of the two halves."""
    half = sample.shape[1] // 2
    return codebook(sample[:, :half], size), codebook(sample[:, half:], size)


def cells_of(units: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of the cell of each vector."""
    half = left.shape[1]
    return nearest(units[:, :half], left) * len(left) + nearest(units[:, half:], right)


def search(units: np.ndarray, queries: np.ndarray, k: int, target: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_in_cells` over an index of ``units`` that is made for the purpose: for what one task holds."""
    if not len(units) or not len(queries):
        return best_in_cells(units, np.zeros(0, np.int64), queries, [[]] * len(queries), k)
    sample = units
    if len(units) > SAMPLE_ROWS:
        sample = units[np.random.default_rng(11).choice(len(units), SAMPLE_ROWS, replace=False)]
    left, right = fit(sample, centroids_of(len(units)))
    cell = cells_of(units, left, right)
    counts = np.bincount(cell, minlength=len(left) ** 2)
    return best_in_cells(units, cell, queries, traversals(queries, left, right, counts, target or scan_target(len(units))), k)


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each distinct value, the number of its value for each row)"""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return first, number.ravel()


# ---- all collections ----------------------------------------------------------------------------------------------


def _answer(k: int, at_least: float, width: int, distinct: bool, names: list[str]):
    """The function that answers a block of queries from a region."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")  # ties and copies by id, whatever the order of arrival
        ids = ids[order]
        units = matrix(vectors.column("unit"), width)[order]
        asked, kinds = queries.column("id").to_numpy(), queries.column("kind").to_numpy()
        wanted = matrix(queries.column("unit"), width)
        if not len(ids) or not len(asked):
            return pa.table({n: pa.array([], t) for n, t in zip(names, types(vectors))})
        cell = vectors.column("cell").to_numpy()[order]
        cells = queries.column("cells").to_pylist()
        first, number = distinct_rows(units)
        first_asked, which = distinct_rows(wanted)
        members = np.argsort(number, kind="stable")
        count = np.bincount(number)
        begin = np.r_[0, np.cumsum(count)[:-1]]
        best, value = best_in_cells(units[first], cell[first], wanted[first_asked], [cells[i] for i in first_asked], k + 1, at_least)
        used = np.where((best >= 0) & (value >= at_least), np.minimum(count[best], 1 if distinct else k + 1), 0)
        # each distinct query's neighbours, with their copies (the smallest ids first)
        per_query = used.sum(1)
        flat = used.ravel()
        inside = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
        near = members[np.repeat(begin[best.ravel()], flat) + inside]
        score = np.repeat(value.ravel(), flat)
        offset = np.r_[0, np.cumsum(per_query)[:-1]]
        length = per_query[which]
        source = np.repeat(np.arange(len(asked)), length)
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = offset[which[source]] + step
        near, score = near[at], score[at]
        own = (kinds[source] == "vector") & (ids[near] == asked[source])
        source, near, score = source[~own], near[~own], score[~own]
        rank = np.arange(len(source)) - np.searchsorted(source, source)
        keep = rank < k
        source, near, score = source[keep], near[keep], score[keep]
        columns = [
            pa.repeat(key[0], len(source)),
            queries.column("kind").combine_chunks().take(pa.array(source)),
            queries.column("id").combine_chunks().take(pa.array(source)),
            vectors.column("id").combine_chunks().take(pa.array(order[near])),
            pa.array(score.astype(np.float32)),
        ]
        return pa.table({n: c.cast(t) for n, c, t in zip(names, columns, types(vectors))})

    def types(vectors: pa.Table) -> list[pa.DataType]:
        kind = vectors.schema.field("id").type
        return [pa.string(), pa.string(), kind, kind, pa.float32()]

    return run


def similar_vectors(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, at_least: float = -2.0, width: int = 64, distinct: bool = False, exact: bool = False
) -> DataFrame:
    """The ``k`` most similar vectors of its collection for every vector, and for every query.

    ``vectors`` and ``queries`` have the columns collection, id and unit (see :func:`unit_vectors`); an id may be a string
    or a number and is unique in its table and collection. Result: collection, kind (``vector`` or ``query``: what was
    asked), id, neighbour, similarity; a vector is not its own neighbour. Neighbours below ``at_least`` are left out.
    Ties are broken by the smaller id. Collections without vectors, and empty tables, give no rows.
    ``distinct``: of copies of a vector only the one with the smallest id (in each slice) is a neighbour. ``exact``: all cells are scanned."""
    kind = dict(vectors.dtypes)["id"]
    names = ["collection", "kind", "id", "neighbour", "similarity"]
    usable = F.col("collection").isNotNull() & F.col("id").isNotNull()
    vectors = vectors.where(usable).select("collection", "id", "unit")
    asked = vectors.select(*[F.col(c).alias(c) for c in vectors.columns], F.lit("vector").alias("kind"))  # new columns, not a self-join
    if queries is not None:
        asked = asked.unionByName(queries.where(usable).select("collection", F.col("id").cast(kind), "unit").withColumn("kind", F.lit("query")))
    sizes = cut(vectors.groupBy("collection").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > SCAN_ROWS)
    entries = vectors.join(small(large), "collection", "left_anti").withColumn("cell", F.lit(0))
    whole = asked.join(small(sizes.where(F.col("n") <= SCAN_ROWS)), "collection", "left_semi")
    whole = whole.select("collection", "id", "unit", "kind", F.lit(0).alias("region"), F.lit(0).alias("slice"), F.array(F.lit(0)).alias("cells"))
    counted = whole.select("collection", "region", "slice")
    many = large.limit(1).count() > 0
    entries = entries.select("collection", "id", "unit", "cell", F.lit(0).alias("region"), F.lit(0).alias("slice"))
    routed = whole
    if many:
        header, indexed = _indexes(vectors, large, width)
        routes = cut(_routes(asked, header, kind, width, exact))
        entries, routed = entries.unionByName(indexed), whole.unionByName(routes)
        counted = counted.unionByName(routes.select("collection", "region", "slice"))
    place = ["collection", "region", "slice"]
    blocks = cut(counted.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    left = entries.join(small(blocks), place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = routed.join(small(blocks), place).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns if c != "blocks"]) for x in (left, right))  # new columns, not a self-join
    found = (
        left.groupBy(*place, "block")
        .cogroup(right.groupBy(*place, "block"))
        .applyInArrow(_flat_key(_answer(k, at_least, width, distinct, names)), f"collection string, kind string, id {kind}, neighbour {kind}, similarity float")
    )
    if many and blocks.where("region > 0 or slice > 0").limit(1).count():
        best = W.partitionBy("collection", "kind", "id").orderBy(F.desc("similarity"), "neighbour")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return found


def _indexes(vectors: DataFrame, large: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of the collections in ``large`` (collection, n).

    header: collection, n, books (both codebooks), cells (cell, n, region, slices: at most the square of MOST_CENTROIDS).
    entries: collection, id, unit, cell, region, slice."""
    rows = vectors.join(small(large), "collection")
    kind = dict(vectors.dtypes)["id"]
    picked = W.partitionBy("collection").orderBy(F.xxhash64("id"), "id")
    sample = rows.select("collection", "n", "unit", F.row_number().over(picked).alias("place")).where(F.col("place") <= SAMPLE_ROWS)
    scan, per_cell = SCAN_ROWS, CELL_ROWS

    def books(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        both = fit(matrix(table.column("unit"), width)[np.argsort(table.column("place").to_numpy())], centroids_of(n, scan, per_cell))
        return pa.table({"collection": [key[0].as_py()], "n": [n], "books": [np.concatenate(both, axis=1).astype(np.float32).tobytes()]})

    fitted = cut(sample.groupBy("collection").applyInArrow(books, "collection string, n bigint, books binary"))

    def enter(table: pa.Table, book: dict) -> pa.Table:
        left, right = _books(book["books"], width)
        cell = cells_of(matrix(table.column("unit"), width), left, right) if len(table) else np.zeros(0, np.int64)
        return pa.table({"collection": table.column("collection"), "id": table.column("id"), "unit": table.column("unit"), "cell": pa.array(cell, pa.int32())})

    entered = cut(_beside(rows.select("collection", "id", "unit"), fitted, enter, f"collection string, id {kind}, unit binary, cell int"))
    order = W.partitionBy("collection").orderBy("cell")  # a row per cell
    cells = entered.groupBy("collection", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("region", F.floor(F.coalesce(before, F.lit(0)) / REGION_ROWS).cast("int")).withColumn("slices", F.ceil(F.col("n") / REGION_ROWS).cast("int"))
    cells = cut(cells)
    header = fitted.join(cells.groupBy("collection").agg(F.collect_list(F.struct("cell", "n", "region", "slices")).alias("cells")), "collection")
    placed = entered.join(small(cells.drop("n"), 1_000_000), ["collection", "cell"])
    return cut(header), placed.select("collection", "id", "unit", "cell", "region", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))


def _books(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.float32).reshape(-1, width)
    return both[:, : width // 2], both[:, width // 2 :]


def _routes(asked: DataFrame, header: DataFrame, kind: str, width: int, exact: bool) -> DataFrame:
    """A row for each region and slice that a query is answered from: collection, id, unit, kind, region, slice, cells."""
    def route(table: pa.Table, head: dict) -> pa.Table:
        left, right = _books(head["books"], width)
        cells, total = head["cells"], head["n"]
        counts, region, slices = np.zeros(len(left) ** 2, np.int64), np.zeros(len(left) ** 2, np.int64), np.zeros(len(left) ** 2, np.int64)
        for c in cells:
            counts[c["cell"]], region[c["cell"]], slices[c["cell"]] = c["n"], c["region"], c["slices"]
        at, regions, parts, lists = [], [], [], []
        units = matrix(table.column("unit"), width)
        for low in range(0, len(units), 4_096):
            for i, mine in enumerate(traversals(units[low : low + 4_096], left, right, counts, total if exact else scan_target(total))):
                groups: dict[tuple[int, int], list[int]] = {}
                for c in mine:
                    for part in range(slices[c]):
                        groups.setdefault((int(region[c]), part), []).append(c)
                for (r, part), own in groups.items():
                    at.append(low + i)
                    regions.append(r)
                    parts.append(part)
                    lists.append(own)
        place = pa.array(at, pa.int64())
        columns = {c: table.column(c).take(place) for c in ("collection", "id", "unit", "kind")}
        return pa.table({**columns, "region": pa.array(regions, pa.int32()), "slice": pa.array(parts, pa.int32()), "cells": pa.array(lists, pa.list_(pa.int32()))})

    rows = asked.join(small(header.select("collection")), "collection", "left_semi").select("collection", "id", "unit", "kind")
    return _beside(rows, header, route, f"collection string, id {kind}, unit binary, kind string, region int, slice int, cells array<int>")


def _beside(rows: DataFrame, header: DataFrame, run: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """``run`` over the rows of each collection with its row of ``header``: without a shuffle where the headers fit every task."""
    cells = F.size("cells") if "cells" in header.columns else F.lit(0)
    size = header.agg(F.sum(F.length("books") + 64 * cells)).first()[0] or 0
    if size <= HEADER_BYTES:
        shipped = rows.sparkSession.sparkContext.broadcast({h["collection"]: h for h in header.toArrow().to_pylist()})

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for name in pc.unique(table.column("collection")).to_pylist():
                    yield from run(table.filter(pc.equal(table.column("collection"), name)), shipped.value[name]).to_batches()

        return rows.mapInArrow(each, schema)
    counts = small(cut(rows.groupBy("collection").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))))
    blocked = rows.join(counts, "collection").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    copies = header.join(counts, "collection").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    blocked, copies = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (blocked, copies))  # new columns, not a self-join

    def both(key: tuple, table: pa.Table, head: pa.Table) -> pa.Table:
        return run(table, head.to_pylist()[0])

    whole = blocked.groupBy("collection", "block").cogroup(copies.groupBy("collection", "block"))
    return whole.applyInArrow(both, schema)


def _flat_key(run):
    def call(key, vectors, queries):
        return run(tuple(x.as_py() for x in key), vectors, queries)

    return call


def pairs_at_least(found: DataFrame) -> DataFrame:
    """Each pair of the result of :func:`similar_vectors` once: collection, low_id, high_id by byte order."""
    low, high = F.least("id", "neighbour").alias("low_id"), F.greatest("id", "neighbour").alias("high_id")
    return found.select("collection", low, high).distinct()
