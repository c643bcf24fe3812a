"""Ranked lexical search: exact inner products over sparse ball trees of documents.

A document is the sparse vector of its integer term impacts, restricted to the terms that
occur in the items; an item is the vector of its term counts times term weights. Tasks build
balanced ball trees over a bounded number of documents. For an item q and the documents x
of a node with centroid c and radius r, q.x <= q.c + |q| r; the bound is rounded up, and the
tree is searched best bound first until no node can reach the items' k-th score. Leaves
are scored in 64-bit integers. The k-th score of a sample of the documents is a lower limit
that all tasks start from, and one that cannot exclude a result.

Both vectors carry the square root of a term's weight, so that frequent terms, which hardly
count, do not widen the balls. Items are taken in blocks of a bounded number of words; more
blocks mean more passes over the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import NO_ID, col
from tenure.llm.decontaminate import words_of
from tenure.session import stage

TOP = 20
#: Words of the items of a block, in expectation; one item is never divided.
BLOCK_WORDS = 200_000
#: Documents of a tree and of a leaf, and entries after which a tree is closed early.
TREE_DOCS, LEAF_DOCS, TREE_ENTRIES = 4096, 64, 4_000_000
#: One document in so many gives the lower limits.
SAMPLE_SHARE = 16


def _grouped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``starts``; no run is empty."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


class Items:
    """The items of a block: numbers of their terms and the products that a search needs."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray) -> None:
        self.terms, self.times = [], []
        for item in counts:
            terms = np.array(sorted(t for t in item if weights[t] > 0), np.int64)
            self.terms.append(terms)
            self.times.append(np.array([item[t] for t in terms.tolist()], np.int64))
        self.asked = [q for q, terms in enumerate(self.terms) if len(terms)]
        self.exact = [weights[t] * c for t, c in zip(self.terms, self.times, strict=True)]
        root = np.sqrt(weights.astype(np.float64))
        scaled = [root[self.terms[q]] * self.times[q] for q in self.asked]
        self.flat = np.concatenate([self.terms[q] for q in self.asked]) if self.asked else np.zeros(0, np.int64)
        self.values = np.concatenate(scaled) if scaled else np.zeros(0)
        self.starts = np.cumsum([0, *(len(x) for x in scaled[:-1])]) if scaled else np.zeros(0, np.int64)
        self.norms = np.array([np.linalg.norm(x) for x in scaled])

    def bounds(self, centroid: np.ndarray, radius: float) -> np.ndarray:
        """Upper bounds of the score of any document in the ball, one for each asked item."""
        near = _grouped(self.values * centroid[self.flat], self.starts)
        return (near + self.norms * radius) * (1 + 1e-9) + 1


class Tree:
    """Balanced ball tree; documents are reordered so that every leaf is one slice."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, root: np.ndarray, items: Items) -> None:
        lengths = np.diff(np.append(starts, len(terms)))
        values = impacts * root[terms]
        squares = _grouped(values * values, starts)
        self.bounds: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.slices: list[tuple[int, int] | None] = []
        order: list[np.ndarray] = []
        placed = 0

        def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = lengths[rows]
            begin = np.cumsum(size) - size
            return np.arange(size.sum()) + np.repeat(starts[rows] - begin, size), begin

        def dense(row: int) -> np.ndarray:
            out = np.zeros(len(root))
            at = slice(starts[row], starts[row] + lengths[row])
            out[terms[at]] = values[at]
            return out

        waiting = [(np.arange(len(starts)), None, -1, 0)]
        while waiting:
            rows, limit, parent, side = waiting.pop()
            at, begin = entries(rows)
            t, v = terms[at], values[at]
            centroid = np.bincount(t, weights=v, minlength=len(root)) / len(rows)
            apart = np.maximum(squares[rows] - 2 * _grouped(v * centroid[t], begin) + centroid @ centroid, 0)
            bound = items.bounds(centroid, math.sqrt(apart.max() + 1e-12 * squares[rows].max()))
            if limit is not None:
                bound = np.minimum(bound, limit)
            node = len(self.bounds)
            self.bounds.append(bound)
            self.children.append(None)
            self.slices.append(None)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            if len(rows) <= LEAF_DOCS:
                self.slices[node] = (placed, placed + len(rows))
                placed += len(rows)
                order.append(rows)
                continue
            # The two ends of the ball; half of the documents go to each.
            one = dense(rows[apart.argmax()])
            from_one = squares[rows] - 2 * _grouped(v * one[t], begin)
            other = dense(rows[from_one.argmax()])
            lean = from_one - (squares[rows] - 2 * _grouped(v * other[t], begin))
            cut = np.argsort(lean, kind="stable")
            half = len(rows) // 2
            waiting += [(rows[cut[half:]], bound, node, 1), (rows[cut[:half]], bound, node, 0)]
        self.order = np.concatenate(order)
        at, self.starts = entries(self.order)
        self.terms, self.impacts = terms[at], impacts[at]
        self.ends = np.append(self.starts[1:], len(at))

    def search(self, q: int, weight: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], floor: int, top: int) -> int:
        """Put the documents of the tree among the ``best`` (score, -id) of asked item ``q``; the leaves scored."""
        bounds, scored = self.bounds, 0
        waiting = [(-bounds[0][q], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < max(floor, best[0][0] if len(best) == top else 1):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(waiting, (-bounds[child][q], child))
                continue
            scored += 1
            a, b = self.slices[node]
            at = slice(self.starts[a], self.ends[b - 1])
            scores = np.add.reduceat(self.impacts[at] * weight[self.terms[at]], self.starts[a:b] - self.starts[a])
            least = max(floor, best[0][0] if len(best) == top else 1)
            for i in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[i]), -int(ids[self.order[a + i]]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, times): the words of each text, and its terms that occur in items."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text or b"")
                met = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                found, n = np.unique(met[met >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(found.tobytes())
                times.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["id", "n", "terms", "times"]
            )

    bodies = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("binary").alias("body"))
    return stage(bodies.mapInArrow(profile, "id long, n long, terms binary, times binary"))


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for row in vectors.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _best(vectors: DataFrame, items: Items, weights: np.ndarray, documents: int, words: int, floors: np.ndarray, top: int) -> DataFrame:
    """(q, id, score) of the ``top`` documents of each item in each task, none below the item's floor."""
    shared = vectors.sparkSession.sparkContext.broadcast((weights, floors, items.terms, items.times))
    tree_docs, tree_entries = TREE_DOCS, TREE_ENTRIES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, floors, terms, times = shared.value
        own = Items([dict(zip(t.tolist(), c.tolist(), strict=True)) for t, c in zip(terms, times, strict=True)], weights)
        root, weight = np.sqrt(weights.astype(np.float64)), np.zeros(len(weights), np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in own.asked]
        for ids, starts, flat, impacts in _forest(batches, documents, words, tree_docs, tree_entries):
            tree = Tree(starts, flat, impacts, root, own)
            reachable = tree.bounds[0] >= np.array([max(floors[q], best[i][0][0] if len(best[i]) == top else 1) for i, q in enumerate(own.asked)])
            for i in np.flatnonzero(reachable).tolist():
                q = own.asked[i]
                weight[own.terms[q]] = own.exact[q]
                tree.search(i, weight, ids, best[i], int(floors[q]), top)
                weight[own.terms[q]] = 0
        rows = [(q, -key, score) for q, found in zip(own.asked, best, strict=True) for score, key in found]
        q, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        names = pa.array([None if i == NO_ID else i for i in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), names, pa.array(scores, pa.int64())], names=["q", "id", "score"])

    return vectors.where(F.length("terms") > 0).mapInArrow(search, "q int, id long, score long")


def _forest(batches: Iterator[pa.RecordBatch], documents: int, words: int, most_docs: int, most_entries: int) -> Iterator[tuple]:
    """Documents of one tree at a time: ids, where their entries start, terms and impacts."""
    ids, terms, impacts, held = [], [], [], 0

    def done() -> tuple:
        starts = np.cumsum([0, *(len(t) for t in terms[:-1])])
        return np.array(ids, np.int64), starts, np.concatenate(terms).astype(np.int64), np.concatenate(impacts)

    for batch in batches:
        for number, n, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            m = 100 - 25 + (25 * n * documents) // words
            tf = np.frombuffer(c, np.int32).astype(np.int64)
            ids.append(NO_ID if number is None else number)
            terms.append(np.frombuffer(t, np.int32))
            impacts.append((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            held += len(tf)
            if len(ids) == most_docs or held >= most_entries:
                yield done()
                ids, terms, impacts, held = [], [], [], 0
    if ids:
        yield done()


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _numbered(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, body, block) of the items, and the number of blocks."""
    item: Column = col(item_col).alias("item")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t or b"")) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    total = benchmark.select(col(text_col).cast("binary").alias("body")).mapInArrow(sized, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    block = F.pmod(F.xxhash64(F.coalesce(col(text_col), F.lit("")), col(item_col)), F.lit(max(1, blocks)))
    return stage(benchmark.select(item, col(text_col).cast("binary").alias("body"), block.alias("block"))), blocks


def search(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP
) -> DataFrame:
    """(item, ``rank``, id, ``score``): the ``top`` documents of every item with a score above 0.

    Terms are runs of ASCII letters and digits and of code points from 128 on, A-Z
    lower-cased. With N documents that have terms, L terms in all, n terms in a document, and
    df documents that hold a term, its weight is w = floor(1000 ln((2N + 2) / (2 df + 1)))
    and a document's m = 75 + 25 n N div L; the score sums w (10^9 tf div (1000 tf + 12 m))
    over the item's terms, repeats included. Equal scores are ranked by ascending id.

    Null and empty texts have no terms: such a document is never found, such an item finds
    nothing. A document without an id comes last among equals. Rows that repeat an id, in
    either table, are documents or items of their own. Empty tables give an empty table.
    Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    items, blocks = _numbered(benchmark, item_col, item_text_col)
    parts = []
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()
        words = [words_of(bytes(r["body"] or b"")) for r in rows]
        vocabulary = {w: i for i, w in enumerate(sorted({w for item in words for w in item}))}
        vectors = _vectors(docs, id_col, text_col, vocabulary)
        documents, total = vectors.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        weights = np.array([term_weight(documents, int(df)) for df in _frequencies(vectors, len(vocabulary))], np.int64)
        asked = Items([Counter(vocabulary[w] for w in item) for item in words], weights)
        floors = np.zeros(len(rows), np.int64)
        sample = vectors.where(F.pmod(F.xxhash64("id", "n"), F.lit(SAMPLE_SHARE)) == 0)
        limits = _ranked(_best(sample, asked, weights, documents, total, floors, top), top).where(F.col("rank") == top)
        for row in limits.select("q", "score").collect():
            floors[row["q"]] = row["score"]
        found = _ranked(_best(vectors, asked, weights, documents, total, floors, top), top)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], T.StructType([T.StructField("q", T.IntegerType()), items.schema["item"]]))
        parts.append(stage(found.join(names, "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")))
    empty = T.StructType([T.StructField(item_col, items.schema["item"].dataType), T.StructField("rank", T.IntegerType())])
    empty = empty.add(id_col, T.LongType()).add("score", T.LongType())
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], empty)
