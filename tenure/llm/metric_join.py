"""Exact Jaccard join of word shingles as a metric-space join.

Jaccard distance is a metric. Between texts nearly all distances are close to 1, so
documents as pivots would put every document into every window. The pivots here are
one-shingle sets under a global order, rare shingles first. The cell of a document is
that of its first pivot; a document within radius r lacks at most r of its first pivots,
so the ball around a document of n shingles reaches the cells of its first
n - ceil(0.85 n) + 1 pivots and no others. It is replicated to those windows only, and any
linked pair meets in a window.

Inside a region the members are joined recursively: each chooses the region's
document pivot (the member nearest to the region's centre) that it shares most with, exact
distances to it are computed and linked members contracted; what is left in other components
is joined member by member, pruned by sizes, positions, shared pivots and the triangle
inequality over distances already known. All links are verified on whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm import seen_twice
from tenure.llm.common import col, mix
from tenure.llm.components import components
from tenure.session import stage

WORDS, PERCENT = 4, 85
#: The shingles of every document are counted for the order of pivots. Documents that make one
#: step of a count, and rows beyond which a step grows, so that a count fits a byte. The order
#: only steers work: any order gives the same links.
SAMPLE_SHARE, SAMPLE_ROWS = 8, 4_000_000
#: Bits of the table of counts (a byte each), and steps that do not tell from chance.
LEAST_BITS, MOST_BITS, CHANCE = 20, 26, 6
SLICE_BITS = 16
SHINGLES_EXPECTED = 512

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 56-bit hashes of the word shingles of a text (A-Z lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole >> 8], np.uint64)
    total = h[: len(h) - size + 1] * _FACTORS[0]
    for i in range(1, size):
        total = mix(total) + h[i : len(h) - size + 1 + i] * _FACTORS[i % 4]
    return np.unique(mix(total) >> np.uint64(8))


def prefix_length(n: int, percent: int) -> int:
    """Pivots whose windows the ball around a set of n shingles reaches."""
    return n - -(-percent * n // 100) + 1


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, body): ``id`` stands for a row by a hash of its name and text, so that rows that repeat a name stay apart."""
    rows = docs.select(col(id_col).cast("long").alias("name"), col(text_col).cast("binary").alias("body"))
    return rows.select(F.xxhash64("name", "body").alias("id"), "name", "body")


def _count_table(bodies: DataFrame, size: int, rows: int) -> tuple[np.ndarray, int]:
    """Counts of shingles over all documents in steps of several, hashed into a bounded table of bytes.

    A task sends its slices of the table compressed, as most cells are empty.
    """
    step = max(SAMPLE_SHARE, -(-rows // SAMPLE_ROWS))
    bits = int(np.clip(np.ceil(np.log2(max(1, rows // step) * SHINGLES_EXPECTED)), LEAST_BITS, MOST_BITS))
    shift, width = np.uint64(56 - bits), 2**SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), np.zeros(2**bits, np.uint16)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = (shingles(text, hashes, size) >> shift).astype(np.int64)
                table[at] = np.minimum(table[at], 60_000) + 1
        for number, part in enumerate(table.reshape(-1, width)):
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(width, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(total // step, 255).astype(np.uint8).tobytes()], pa.binary())], names=["slice", "n"])

        for batch in batches:
            for number, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    if now is not None:
                        yield done()
                    now = number
                    total[:] = 0
                total += np.frombuffer(zlib.decompress(packed), np.uint16)
        if now is not None:
            yield done()

    parts = bodies.select("body").mapInArrow(count, "slice int, n binary")
    table = np.zeros(2**bits, np.uint8)
    for r in parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, n binary").collect():
        table[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["n"], np.uint8)
    table[table <= CHANCE] = 0
    return table, bits


def _profiles(bodies: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """(id, name, n, digest, prefix): size of the set, digest of the whole set, and its first pivots in order."""
    table, bits = _count_table(bodies, size, rows)
    counts = bodies.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(56 - bits)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rank = WordHashes(), counts.value
        for batch in batches:
            sizes, digests, ends, tokens = [], [], [0], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, hashes, size)
                n = len(found)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if n:
                    m = prefix_length(n, percent)
                    key = (rank[(found >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | found
                    key = np.partition(key, m - 1)[:m] if m < n else key
                    key.sort()
                    tokens.append((key & np.uint64(2**56 - 1)).view(np.int64))
                ends.append(ends[-1] + (len(tokens[-1]) if n else 0))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), prefix], names=["id", "name", "n", "digest", "prefix"])

    return stage(bodies.mapInArrow(profile, "id long, name long, n int, digest binary, prefix array<long>"))


def _regions(reps: DataFrame, rows: int) -> DataFrame:
    """(token, id, n, pos) for the pivots that several sets have among their first ones."""
    bits = seen_twice.bits_for(rows, SHINGLES_EXPECTED // 8)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = seen_twice.Collector(bits)
        for batch in batches:
            yield from sink.add(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        yield from sink.flush()

    twice = reps.sparkSession.sparkContext.broadcast(seen_twice.merged(reps.select("prefix").mapInArrow(collect, seen_twice.SCHEMA), bits))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            prefix = batch.column(2)
            lengths = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), lengths)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            shared = seen_twice.maybe_twice(tokens.view(np.uint64), twice.value, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[shared]), pa.array(ids[row[shared]]), pa.array(sizes[row[shared]]), pa.array(pos[shared].astype(np.int32))],
                names=["token", "id", "n", "pos"],
            )

    return stage(reps.select("id", "n", "prefix").mapInArrow(members, "token long, id long, n int, pos int"))


def _needed(n1: Column, n2: Column, percent: int) -> Column:
    """Shingles that two sets must share to be linked."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent) - F.lit(1e-9))


def _may_link(percent: int) -> Column:
    """Sizes and positions of two members x, y of a region allow a link whose first shared pivot is the region's."""
    needed = _needed(F.col("x.n"), F.col("y.n"), percent)
    fits = F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n")
    return fits & (F.col("x.n") - F.col("x.pos") >= needed) & (F.col("y.n") - F.col("y.pos") >= needed)


def _measured(pairs: DataFrame, bodies: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """(a, b, distance, linked) of candidate pairs, from their whole texts.

    A filter of the ids (of bounded size) keeps other documents out of the shuffle.
    """
    pairs = stage(pairs)
    bits = seen_twice.bits_for(rows, 1)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = seen_twice.Collector(bits)
        for batch in batches:
            for column in batch.columns:
                yield from sink.add(column.to_numpy(zero_copy_only=False).view(np.uint64))
        yield from sink.flush()

    wanted = bodies.sparkSession.sparkContext.broadcast(seen_twice.merged(pairs.select("a", "b").mapInArrow(collect, seen_twice.SCHEMA), bits, twice=False))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(seen_twice.maybe_twice(ids, wanted.value, bits)))

    texts = stage(bodies.where("name is not null").select("id", "body").mapInArrow(asked, "id long, body binary")).dropDuplicates(["id"])
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}

        def of(number: int, text: bytes) -> np.ndarray:
            if number not in known:
                if len(known) >= 64:
                    known.clear()
                known[number] = shingles(text, hashes, size)
            return known[number]

        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            shared, union = [], []
            for i in range(len(a)):
                p, q = of(a[i], x[i]), of(b[i], y[i])
                shared.append(len(np.intersect1d(p, q, assume_unique=True)))
                union.append(len(p) + len(q) - shared[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "both"])

    measured = joined.select("a", "b", "body_a", "body_b").mapInArrow(measure, "a long, b long, shared long, both long")
    return stage(measured.select("a", "b", (1 - F.col("shared") / F.col("both")).alias("distance"), (100 * F.col("shared") >= percent * F.col("both")).alias("linked")))


def _to_pivots(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with the document pivot, among those of its regions, that it shares most pivots with.

    The pivot of a region is the member with the fewest shingles before the shared one.
    """
    pivots = regions.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("y"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pivots = stage(pivots.select("token", F.col("y.id").alias("id"), F.col("y.n").alias("n"), F.col("y.pos").alias("pos")))
    met = regions.alias("x").join(pivots.alias("y"), "token").where((F.col("x.id") != F.col("y.id")) & _may_link(percent))
    shared = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("a").agg(F.max(F.struct("c", -F.col("b"))).alias("best"))
    return best.select(F.least("a", -F.col("best.col2")).alias("a"), F.greatest("a", -F.col("best.col2")).alias("b")).distinct()


def _left_over(regions: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs that meet in a region, may be linked and lie in different components so far."""
    labels = stage(components(near.where("linked")))
    reach = near.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "distance").union(near.select(F.col("b"), F.col("a"), F.col("distance")))
    reach = reach.groupBy("id").agg(F.min(F.struct("distance", "pivot")).alias("r"))
    own = regions.join(labels, "id", "left").join(reach, "id", "left")
    own = stage(
        own.select("token", "id", "n", "pos", F.coalesce("component", "id").alias("component"), F.col("r.pivot").alias("pivot"), F.col("r.distance").alias("distance"))
    )
    mixed = own.groupBy("token").agg(F.min(F.struct("pos", "id", "component")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    held = stage(own.join(mixed.select("token", F.col("p.component").alias("major")), "token"))
    # Every pair of two components has a member outside of the component of the region's pivot.
    x, y = held.where("component <> major").alias("x"), held.alias("y")
    apart = F.coalesce((F.col("x.pivot") == F.col("y.pivot")) & (F.abs(F.col("x.distance") - F.col("y.distance")) > F.lit((100 - percent) / 100 + 1e-9)), F.lit(False))
    once = (F.col("y.component") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & once & _may_link(percent) & ~apart
    met = x.join(y, meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return met.distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) of every row of ``docs``.

    The set of a text holds its distinct shingles of ``size`` words (runs without ASCII
    white space, A-Z lower-cased); a shorter text is one shingle. Two sets are linked when
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reachable
    over links. Shingles are compared by 56-bit hashes.

    Null, empty and blank texts have no shingles and are linked with nothing. A row without
    an id has a null component and links nothing. Rows that repeat an id are judged each
    by its own text. Ids are whole numbers. An empty table gives an empty table. Other columns of ``docs``, whatever
    their names, are not read.
    """
    bodies, rows = _bodies(docs, id_col, text_col), docs.count()
    profiles = _profiles(bodies, size, percent, rows)
    # Identical sets are one class; only one of its rows is joined.
    classes = profiles.where("n > 0 and name is not null").groupBy("digest")
    first = classes.agg(F.min(F.struct("name", "id")).alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    reps = stage(first.select("digest", F.col("row.name").alias("name"), F.col("row.id").alias("id"), "n", "prefix"))
    regions = _regions(reps, rows)
    near = _measured(_to_pivots(regions, percent), bodies, size, percent, rows)
    rest = _measured(_left_over(regions, near, percent), bodies, size, percent, rows)
    links = near.where("linked").select("a", "b").union(rest.where("linked").select("a", "b"))
    labels = reps.select("digest", "name", "id").join(components(links), "id", "left")
    owners = stage(labels.select("digest", "name", F.coalesce("component", "id").alias("root")))
    least = owners.groupBy("root").agg(F.min("name").alias("component"))
    owners = stage(owners.join(least, "root").select("digest", "component"))
    judged = profiles.select("name", F.col("n").cast("long").alias("n_shingles"), "digest").join(owners, "digest", "left")
    component = F.when(F.col("name").isNotNull(), F.coalesce("component", "name"))
    return judged.select(F.col("name").alias(id_col), "n_shingles", component.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` without those that are not the smallest id of their component.

    Rows without an id, and texts without shingles, stay; so do all rows of an id of which
    one row stays.
    """
    linked = link_documents(docs, id_col, text_col, size, percent).where(col(id_col).isNotNull())
    away = linked.groupBy(col(id_col).alias("__away")).agg(F.min((F.col("component_id") != col(id_col)).cast("int")).alias("gone")).where("gone = 1")
    return docs.join(stage(away.select("__away")), col(id_col).cast("long") == F.col("__away"), "left_anti")
