"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing needs only how many pieces there are of each length. Lengths are at
most the largest capacity, so the counts are a bounded table whatever the corpus; the
driver plans on them and handles equal bins as one range of bin numbers. Every piece
then finds its bin from its length and its number among the pieces of that length.

A piece goes to the open bin with the least room that still holds it. If there is none,
the capacity that is cheapest for each token it is expected to hold is opened; finally
each bin shrinks to the smallest capacity that holds its contents.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import col, extended, others
from tenure.session import stage

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: One window task numbers about so many pieces of one length.
PIECES_PER_RUN = 50_000
PRODUCED = ("piece", "start", "length", "bin_id", "bin_offset", "bin_capacity")
_WORD = re.compile(rb"[^ \t-\r]+")


def sequence_cost(capacity: int) -> float:
    """Cost of one sequence: its tokens, attention over them, and a fixed part."""
    return capacity * (1 + capacity / 16384) + 64


@dataclass
class Plan:
    """Where pieces go: rows (length, first ordinal, pieces, first bin, pieces a bin, offset) and (first bin, capacity)."""

    placed: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)  # first bin, bins, used, capacity


def plan_bins(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """Best-fit decreasing over pieces given as length -> number."""
    sizes = sorted(capacities)
    plan = Plan()
    lengths = sorted((n for n in counts if n > 0), reverse=True)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, capacity)
    rooms: list[int] = []
    next_bin = 0
    ascending = lengths[::-1]
    tokens_up_to = np.concatenate(([0], np.cumsum([n * counts[n] for n in ascending], dtype=np.float64)))

    def put_back(room: int, first: int, bins: int, capacity: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((first, bins, capacity))

    def cheapest(length: int, left: int) -> int:
        """Capacity with the least cost for a token: own pieces first, then shorter ones that are still to come."""
        best = None
        for c in sizes:
            if c < length:
                continue
            own = min(c // length, left) * length
            shorter = bisect.bisect_right(ascending, min(c - own, length - 1))
            filled = own + min(c - own, tokens_up_to[shorter])
            value = (cost(c) / filled, c)
            best = min(best, value) if best else value
        return best[1]

    for length in lengths:
        left, ordinal = counts[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, bins, capacity = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room = capacity = cheapest(length, left)
                first, bins = next_bin, -(-left // (room // length))
                next_bin += bins
            each = room // length
            full = min(bins, left // each)
            used = capacity - room
            if full:
                plan.placed.append((length, ordinal, full * each, first, each, used))
                ordinal, left = ordinal + full * each, left - full * each
                put_back(room - each * length, first, full, capacity)
            if full < bins:
                if left:  # fewer pieces than one more bin takes
                    plan.placed.append((length, ordinal, left, first + full, each, used))
                    put_back(room - left * length, first + full, 1, capacity)
                    full, left = full + 1, 0
                if full < bins:
                    put_back(room, first + full, bins - full, capacity)
    for room, groups in open_.items():
        for first, bins, capacity in groups:
            used = capacity - room
            plan.bins.append((first, bins, used, sizes[bisect.bisect_left(sizes, used)]))
    plan.bins.sort()
    return plan


def words_in(text: Column) -> Column:
    """Words of a text (runs without ASCII white space) and one end mark; 0 without words."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.when(n > 0, n + 1).otherwise(0)


def cut_texts(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """One row per piece of at most ``most`` words; the pieces of a text put together are the text."""
    passed = others(docs, *PRODUCED)
    at = next(i for i, c in enumerate(passed) if c.lower() == text_col.lower())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces = [], []
            for i, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                size = len((text or b"").split())
                size += size > 0
                if size <= most:
                    rows.append(i)
                    pieces.append((text, 0, 0, size))
                    continue
                starts = [0, *(m.start() for k, m in enumerate(_WORD.finditer(text)) if k and k % most == 0), len(text)]
                for k in range(-(-size // most)):
                    rows.append(i)
                    pieces.append((text[starts[k] : starts[k + 1]] if k + 1 < len(starts) else b"", k, k * most, min(most, size - k * most)))
            columns = batch.take(pa.array(rows, pa.int64())).columns
            columns[at] = pa.array([p[0] for p in pieces], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([p[j] for p in pieces], pa.int64()) for j in (1, 2, 3))], names=[*passed, *PRODUCED[:3]])

    return docs.select(*[col(c) for c in passed]).mapInArrow(cut, extended(docs, passed, "piece long, start long, length long"))


def cut_lengths(docs: DataFrame, length: Column, most: int) -> DataFrame:
    """The same pieces without their texts, for documents of a given length."""
    passed = others(docs, *PRODUCED)
    whole = F.lit(most).cast("long")
    sized = docs.select(*[col(c) for c in passed], F.coalesce(length, F.lit(0)).cast("long").alias("__size"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("__size") - 1) / whole)))
    cut = sized.select("*", F.explode(pieces).alias("piece")).withColumn("start", F.col("piece") * whole)
    return cut.withColumn("length", F.least(whole, F.col("__size") - F.col("start"))).drop("__size")


def pack(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """Place every document; one row for each of its pieces, with its place.

    Columns: those of ``docs``, then ``piece`` (number within the document), ``start``
    (words of the document before it), ``length``, ``bin_id``, ``bin_offset`` and
    ``bin_capacity``. Without ``length`` a document has its words and one end mark, and its
    text is cut with it; with ``length``, a whole number for each row, texts are not read.
    A document longer than the largest capacity is cut into pieces of that length and
    a rest; nothing is left out.

    Null, empty and blank texts, and lengths of null, 0 or less, give one piece without a
    bin. Rows that repeat an id are documents of their own. An empty table gives an empty
    table. Columns named like a produced one are replaced.
    """
    spark, most = docs.sparkSession, max(capacities)
    passed = others(docs, *PRODUCED)
    cut = stage(cut_texts(docs, text_col, most) if length is None else cut_lengths(docs, length, most))
    runs = max(1, cut.count() // PIECES_PER_RUN)
    run = F.pmod(F.xxhash64(col(id_col), F.col("piece")), F.lit(runs))
    tally = cut.groupBy("length", run.alias("__run")).agg(F.count(F.lit(1)).alias("n"))
    # Lengths times runs: one row for every PIECES_PER_RUN pieces and length.
    tally = stage(tally)
    before = tally.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, capacities, cost)
    placed = spark.sparkContext.broadcast({n: np.array([p[1:] for p in plan.placed if p[0] == n], np.int64) for n in {p[0] for p in plan.placed}})
    bins = spark.sparkContext.broadcast(np.array([(b[0], b[3]) for b in plan.bins], np.int64).reshape(-1, 2))
    order = Window.partitionBy("length", "__run").orderBy(col(id_col), "piece")
    numbered = cut.withColumn("__run", run).withColumn("__ordinal", F.row_number().over(order) - 1)
    numbered = numbered.join(before.select("length", "__run", F.coalesce("__before", F.lit(0)).alias("__before")), ["length", "__run"])
    rows = numbered.select(*[col(c) for c in passed], "piece", "start", "length", (F.col("__ordinal") + F.col("__before")).alias("__ordinal"))
    width = len(passed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ordinals = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in (2, 3))
            bin_, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths[lengths > 0]):
                own, table = np.flatnonzero(lengths == n), placed.value[int(n)]
                at = np.searchsorted(table[:, 0], ordinals[own], side="right") - 1
                among = ordinals[own] - table[at, 0]
                bin_[own] = table[at, 2] + among // table[at, 3]
                offset[own] = table[at, 4] + among % table[at, 3] * n
            known = bins.value
            capacity = known[np.maximum(np.searchsorted(known[:, 0], bin_, side="right") - 1, 0), 1] if len(known) else np.zeros(len(bin_), np.int64)
            none = bin_ < 0
            columns = [pa.array(x, pa.int64(), mask=none) for x in (bin_, offset, capacity)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 3], *columns], names=[*passed, *PRODUCED])

    schema = cut.select(*[col(c) for c in passed], "piece", "start", "length").schema
    for name in PRODUCED[3:]:
        schema = schema.add(name, "long")
    return rows.mapInArrow(place, schema)
