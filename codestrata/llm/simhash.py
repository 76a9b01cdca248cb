"""Near-duplicate removal: 256-bit SimHash, bit-sampling tables, verified distances, one document of each group stays.

1. A document's fingerprint is the sign of the summed hash bits of its distinct word pairs (case and ASCII punctuation
   ignored; the word itself when it has one only).
2. Documents with the same fingerprint are one group at once, so a copy costs one row from here on.
3. Each of ``tables`` tables samples ``bits`` coordinates; fingerprints equal there share a bucket. Two fingerprints
   that differ in exactly ``distance`` bits share one with probability ``RECALL`` at least, closer ones with more: `plan`
   takes as many tables as that needs, and the number of bits that makes this the least work for so many fingerprints.
   No bucket is cut or split. One of more than ``cap`` returns fewer links, but they connect what all of its pairs
   within ``distance`` connect: a leader takes all near it, each of the rest is still compared with those taken (but
   where the triangle inequality rules them out), and then the rest goes on without them. When leaders take few, all
   pairs that are left are compared.
4. Pairs of a bucket count if they differ in at most ``distance`` of the 256 bits. Connected documents form a group;
   the one with the least id stays.

Defined results
* null id: never compared, every row kept; null text or text without words: never compared, kept;
* an id that occurs in several rows: all of its texts are compared, and if one of them goes, the id and all of its rows go;
  else one row stays, the one whose text has the least hash (of rows alike in id and text any one, whatever is in other columns);
* equal texts are at distance 0, however short; ties cannot occur, as ids decide; empty tables give empty ones; columns of
  any name are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, folded_words, fresh, mix, release, slices, table

WIDTH = 256
CAP = 256
DISTANCE = 64
RECALL = 0.92
#: The fewest and most sampled bits, and what a row of a table costs in comparisons of two fingerprints (20 ns each): 3 us of CPU, and 47
#: bytes that are written, sent and read, at 20 MB a second and core.
BITS, ROW_COST = (6, 14), 500
_SEED = 20240229


def fingerprints(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) uint8 fingerprints and a mask of the texts that have words."""
    words = [folded_words(t) if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(texts), WIDTH // 8), np.uint8)
    if not counts.sum():
        return out, counts > 0
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero(counts):
        h = flat[starts[i] : starts[i] + counts[i]]
        grams = h if len(h) == 1 else np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        total = np.zeros(WIDTH, np.int64)
        for at in range(0, len(grams), 8192):
            part = grams[at : at + 8192]
            lanes = np.stack([mix(part + np.uint64(k + 1)) for k in range(WIDTH // 64)], axis=1)
            bits = np.unpackbits(lanes.view(np.uint8), axis=1)
            total += _column_sums(bits)
        out[i] = np.packbits(2 * total > len(grams))
    return out, counts > 0


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of the columns of a 0/1 uint8 matrix: up to 255 rows add without leaving a byte."""
    rows = len(bits)
    whole = rows // 240 * 240
    total = np.zeros(bits.shape[1], np.int64)
    if whole:
        total += bits[:whole].reshape(-1, 240, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    if rows > whole:
        total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return total


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sig): documents that have an id and words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                sig, there = fingerprints(part.column(1).to_pylist(), hashes)
                ids = part.column(0).filter(pa.array(there))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([s.tobytes() for s in sig[there]], pa.binary())], ["doc_id", "sig"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, sig binary")


def _samples(tables: int) -> np.ndarray:
    """For each table an order of all coordinates: the first ones are its sample, the next ones the additional bits."""
    rng = np.random.default_rng(_SEED)
    return np.stack([rng.permutation(WIDTH) for _ in range(tables)])


def tables_for(bits: int, distance: int, recall: float = RECALL) -> int:
    """How many tables let a pair at ``distance`` share a bucket with probability ``recall``."""
    same = math.comb(WIDTH - distance, bits) / math.comb(WIDTH, bits)
    return math.ceil(math.log1p(-recall) / math.log1p(-same)) if same < 1 else 1


def plan(n: int, distance: int) -> tuple[int, int]:
    """(tables, bits) for n fingerprints: rows and comparisons within buckets cost least, at a recall that n doesn't change."""
    return min(((tables_for(b, distance), b) for b in range(BITS[0], BITS[1] + 1)), key=lambda x: x[0] * (ROW_COST + n / 2 ** (x[1] + 1)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each of a and each of b, up to 255 (a pair that differs in all bits has that too)."""
    words = np.ascontiguousarray(b.T)
    differ, count = np.empty((len(a), len(b)), np.uint64), np.empty((len(a), len(b)), np.uint8)
    d = np.zeros((len(a), len(b)), np.uint8)
    for w in range(a.shape[1]):
        np.bitwise_xor(a[:, w, None], words[w], out=differ)
        np.bitwise_count(differ, out=count)
        if w < 3:
            d += count
        else:
            np.add(d, np.minimum(count, 255 - d), out=d)
    return d


def bucket_links(ids: np.ndarray, sigs: np.ndarray, order: np.ndarray, used: int, cap: int, distance: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Verified (a, b, distance) arrays of one bucket, which connect all that its pairs do; sigs is (n, 4) uint64.

    ``order`` and ``used``, the table's coordinates, aren't needed, as no bucket is split by more of them.
    """
    out = []
    at = np.arange(len(ids))
    vain = 0
    while len(at) > cap and vain < 8:
        d = _distances(sigs[at[:1]], sigs[at[1:]])
        near = d <= distance
        taken, rest = at[1:][near], at[1:][~near]
        out.append((np.repeat(ids[at[0]], len(taken)), ids[taken], d[near]))
        by = np.argsort(d[near], kind="stable")[::-1]
        taken, reach = taken[by], d[near][by]
        far = np.argsort(d[~near], kind="stable")
        away, left = d[~near][far], rest[far]
        step = max(1, (1 << 18) // max(1, len(left)))
        for k in range(0, len(taken), step):
            # Of those at most reach from the leader, none is near what is more than distance + reach from it.
            left_ = left[: np.searchsorted(away, distance + reach[k], side="right")]
            if not len(left_):
                break
            g = _grid(sigs[taken[k : k + step]], sigs[left_])
            i = g.argmin(axis=0)
            least = g[i, np.arange(len(left_))]
            met = least <= distance
            out.append((ids[taken[k : k + step][i[met]]], ids[left_[met]], least[met].astype(np.int32)))
        vain += 32 * len(taken) < len(at)
        at = np.roll(rest, -(len(rest) // 3))
    step = max(1, (1 << 16) // max(1, len(at)))  # a grid that stays in the processor's cache
    for k in range(0, len(at), step):
        g = _grid(sigs[at[k : k + step]], sigs[at[k:]])
        i, j = np.nonzero(g <= distance)
        i, j = i[upper := i < j], j[upper]
        out.append((ids[at[k + i]], ids[at[k + j]], g[i, j].astype(np.int32)))
    return out


def candidate_pairs(signed: DataFrame, tables: int, bits: int, cap: int, distance: int) -> DataFrame:
    """(a, b, distance) of distinct fingerprints (columns id, sig) that share a bucket and lie close together."""
    orders = _samples(tables)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
            unpacked = np.unpackbits(raw, axis=1)
            bucket = np.stack([unpacked[:, o[:bits]].astype(np.int64) @ weights + (np.int64(t) << 32) for t, o in enumerate(orders)])
            for row in bucket:
                yield pa.RecordBatch.from_arrays([pa.array(row), batch.column(0), batch.column(1)], ["bucket", "id", "sig"])

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            bucket, ids, sigs = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            ends = np.append(edge, len(bucket)) if last else edge
            begins = np.concatenate([[0], edge])[: len(ends)]
            found = []
            for b, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
                found += bucket_links(ids[b:e], sigs[b:e], orders[int(bucket[b]) >> 32], bits, cap, distance)
            held[:] = [] if last or not len(edge) else [(bucket[edge[-1] :], ids[edge[-1] :], sigs[edge[-1] :])]
            if not last and not len(edge):
                held[:] = [(bucket, ids, sigs)]
            if found:
                a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "distance"])

        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sigs))
                yield from flush(False)
        if held:
            yield from flush(True)

    keyed = signed.select("id", "sig").mapInArrow(keys, "bucket long, id long, sig binary")
    sorted_ = keyed.repartition("bucket").sortWithinPartitions("bucket", "id")
    return sorted_.mapInArrow(links, "a long, b long, distance int")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in the undirected edges (a, b): root is the least id connected with it.

    Alternating large-star and small-star steps: each links ids straight to the least neighbour, so the rounds grow
    with the logarithm of the number of ids, and no id's neighbours are gathered in one place.
    """
    spark = edges.sparkSession
    now = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        after = checkpoint(small)
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (now, after)]
        now = after
        release(spark)
        if same[0] == same[1]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            )


def near_duplicates(docs: DataFrame, tables: int | None = None, bits: int | None = None, cap: int = CAP, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, duplicate_of): each document that goes, and the one of its group that stays.

    The members of a fingerprint are rows, never one list; many of one fingerprint are joined with its one root.
    """
    made = checkpoint(with_fingerprints(docs))
    signed = checkpoint(made.groupBy("sig").agg(F.min("doc_id").alias("id")))
    bits = bits or plan(signed.count(), distance)[1]
    pairs = candidate_pairs(signed, tables or tables_for(bits, distance), bits, cap, distance)
    roots = components(pairs.select("a", "b"))
    rooted = signed.join(roots, "id", "left").select("sig", F.coalesce("root", "id").alias("duplicate_of"))
    return made.join(rooted, "sig").select("doc_id", "duplicate_of").filter("doc_id <> duplicate_of").distinct()


def deduplicate(docs: DataFrame, **options: int) -> DataFrame:
    """The documents that stay, with the columns they came with.

    Ids decide; the texts are moved once, to be joined with the ids that go or occur in several rows.
    """
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("h")).distinct()
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("id"), F.xxhash64("text").alias("h")).filter("id IS NOT NULL")
    several = checkpoint(rows.groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter("n > 1").select("id", "h"))
    ids = several.unionByName(gone).groupBy("id").agg(F.min(F.struct("h")).alias("first"))  # a row of null hash comes first: gone
    i, f = fresh(docs, "_id", "_first")
    found = docs.join(ids.select(F.col("id").alias(i), F.col("first").alias(f)), key == F.col(i), "left")
    out = found.filter(F.col(f).isNull())
    if several.limit(1).count():
        repeated = found.filter(F.col(f)["h"] == F.xxhash64("text"))
        out = out.unionByName(repeated.dropDuplicates([i]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_near_dedup": op7}
ORACLE_SQL: dict[str, str] = {}
