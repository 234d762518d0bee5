"""Evaluation texts that leaked into training documents, by greedy string tiling.

Method. Tokens are words (the longest runs of letters and digits after NFKC and lower-casing) or, for items in languages without
blanks, single letters and digits. All runs of ``seed`` tokens of the items are hashed (Karp-Rabin) into a table, and a Bloom filter of these
hashes, of bounded size, goes to every task. One scan of the documents computes the same running hash and keeps the documents with hashes
that pass the filter; a join on the hash finds the pairs that share a seed, and drops what passed by chance. Each such pair is tiled:
the longest match of tokens that are not marked yet is marked, again and again, down to ``seed`` tokens, hashes being verified by the
tokens. A pair is reported with the length of its longest tile and the share of the item that the tiles cover, so that passages in
another order count too.

Whole documents and whole items are compared; nothing is capped. Neither items nor hashes come to the driver, only the filter's bits. With
more items than the filter is sized for, more documents pass it by chance, and the join drops them: results stay the same."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import cut

#: Bits of the filter for a seed, and in all (8 MB); probes of a hash.
SEED_BITS, MOST_BITS, PROBES = 64, 1 << 26, 4
#: Languages whose items are compared by letters.
BY_LETTER = ("ja", "zh", "th")

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def _codes(tokens: Sequence[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(tokens), np.uint64)
    for i, token in enumerate(tokens):
        code = known.get(token)
        if code is None:
            code = known[token] = xxhash.xxh64_intdigest(token)
        out[i] = code
    return out


def _letters(joined: str) -> np.ndarray:
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return points ^ (points >> np.uint64(31))


def running_hash(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all runs of ``length`` codes, as differences of prefix sums."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(codes), _BASE, np.uint64))
        down = np.cumprod(np.full(len(codes), _INVERSE, np.uint64))
        sums = np.r_[np.uint64(0), np.cumsum(codes * down, dtype=np.uint64)]
        return (sums[length:] - sums[:-length]) * up[: len(codes) - length + 1]


def tiles(one: Sequence[str], other: Sequence[str], shared: Sequence[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (place in one, place in other, length) of the tiles, longest first.

    ``shared``: pairs of places where ``least`` equal tokens may begin."""
    runs: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}
    for i, j in sorted(shared):
        if i < reach.get(i - j, -1):
            continue  # within a run that was followed already
        n = 0
        while i + n < len(one) and j + n < len(other) and one[i + n] == other[j + n]:
            n += 1
        if n >= least:
            runs.append((-n, i, j))
            reach[i - j] = i + n - least + 1
    heapq.heapify(runs)
    used_one, used_other = np.zeros(len(one), bool), np.zeros(len(other), bool)
    out = []
    while runs:
        length, i, j = heapq.heappop(runs)
        length = -length
        free = ~(used_one[i : i + length] | used_other[j : j + length])
        if free.all():
            used_one[i : i + length] = used_other[j : j + length] = True
            out.append((i, j, length))
            continue
        steps = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(steps[::2], steps[1::2]):  # what is left of it, between marked tokens
            if b - a >= least:
                heapq.heappush(runs, (-int(b - a), i + int(a), j + int(a)))
    return out


def _hashes(text: str, letter: bool, length: int, known: dict[str, int]) -> tuple[Sequence[str], np.ndarray]:
    """(tokens of a text, hashes of their runs). Runs of letters and of words have different hashes."""
    token = words(text)
    if letter:
        joined = "".join(token)
        return joined, running_hash(_letters(joined), length) ^ _BASE
    if len(known) > 1_000_000:
        known.clear()
    return token, running_hash(_codes(token, known), length)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the filter (probe, hash) of some hashes."""
    steps = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes + np.arange(PROBES, dtype=np.uint64)[:, None] * steps * _BASE) % np.uint64(bits)


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """Words of 64 bits of the Bloom filter of the hashes: an aggregation by word, of which at most MOST_BITS / 64 come to the driver."""
    bits = min(MOST_BITS, 1 << max(16, (SEED_BITS * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_positions(batch.column("hash").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = seeds.select("hash").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _positions(hashes, len(table) * 64)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


def _shared(one: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places with equal hashes."""
    order = np.argsort(other, kind="stable")
    low, high = np.searchsorted(other[order], one, "left"), np.searchsorted(other[order], one, "right")
    return [(int(i), int(order[j])) for i in np.flatnonzero(high > low) for j in range(low[i], high[i])]


def leaks(documents: DataFrame, items: DataFrame, seed: int = 12, seed_letters: int = 20, longest: int = 12, longest_letters: int = 20, coverage: float = 2.0) -> DataFrame:
    """Pairs of documents (doc_id, text) and leaked items (item_id, lang, text): doc_id, item_id, n_tiles, longest, covered.

    A pair counts if its longest tile has at least ``longest`` words (``longest_letters`` letters for the languages of
    :data:`BY_LETTER`), or if the tiles of at least ``seed`` tokens cover at least the share ``coverage`` of the item. Null and empty
    texts match nothing; of rows with equal ids each is compared by itself, and the pair is reported for each."""
    kinds = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_tiles int, longest int, covered double"
    letter = F.coalesce(F.col("lang").isin(*BY_LETTER), F.lit(False)).alias("letter")
    tests = cut(items.where("text is not null").select("item_id", letter, F.col("text").alias("test"), F.monotonically_increasing_id().alias("item")))

    def hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            found = [np.unique(_hashes(t, k, seed_letters if k else seed, known)[1]) for t, k in zip(batch.column("test").to_pylist(), batch.column("letter").to_pylist())]
            place = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            hashes = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(place), batch.column("letter").take(place), pa.array(hashes)], ["item", "letter", "hash"])

    seeds = cut(tests.mapInArrow(hash_items, "item bigint, letter boolean, hash bigint"))
    counts = {r.letter: r["count"] for r in seeds.groupBy("letter").count().collect()}  # two rows at most
    shipped = documents.sparkSession.sparkContext.broadcast((_filter(seeds, sum(counts.values())), [(k, seed_letters if k else seed) for k in counts]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ways = shipped.value
        known: dict[str, int] = {}
        for batch in batches:
            at, hits = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                own = np.concatenate([np.zeros(0, np.uint64), *[_hashes(text, k, length, known)[1] for k, length in ways]])
                own = np.unique(own[_passes(table, own)])
                if len(own):
                    at.append(n)
                    hits.append(own.view(np.int64))
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(place), batch.column("text").take(place), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "hits"])

    held = documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, f"doc_id {kinds[0]}, text string, hits array<bigint>")
    held = cut(held.withColumn("row", F.monotonically_increasing_id()))
    pairs = held.select("row", F.explode("hits").alias("hash")).join(seeds.select("item", "hash"), "hash").select("row", "item").distinct()
    both = held.select("row", "doc_id", "text").join(pairs, "row").join(tests, "item").select("doc_id", "text", "item_id", "letter", "test")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        tokens = lru_cache(1_024)(lambda text, by_letter, length: _hashes(text, by_letter, length, known))  # a text comes once for each of its pairs
        for batch in batches:
            at, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("text", "test", "letter")]
            for n, (text, test, by_letter) in enumerate(zip(*columns)):
                length = seed_letters if by_letter else seed
                (own, mine), (wanted, other) = (tokens(t, by_letter, length) for t in (text, test))
                tiled = tiles(own, wanted, _shared(mine, other), length)
                if tiled:
                    covered = sum(t[2] for t in tiled) / len(wanted)
                    if tiled[0][2] >= (longest_letters if by_letter else longest) or covered >= coverage:
                        at.append(n)
                        found.append((len(tiled), tiled[0][2], covered))
            place = pa.array(at, pa.int64())
            values = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(place), batch.column("item_id").take(place), *values], ["doc_id", "item_id", "n_tiles", "longest", "covered"])

    return both.mapInArrow(tile, schema)
