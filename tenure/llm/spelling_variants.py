"""Spelling variants: words one edit apart, found by PartEnum signatures of letter multisets.

The multiset of a word's letters is a binary vector with one dimension for the i-th
occurrence of a letter. One edit changes at most two dimensions, so of ``PARTS`` parts of the
dimensions at least ``PARTS - 2`` agree. Every choice of that many parts is a signature, and
a pair is judged only at the first signature that both words have. Letters alone make large
groups, so signatures are joined together with half a word: the edit leaves either the first
or the last half of the shorter word as it is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import col, mix
from tenure.session import stage

SHORTEST, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: A run loses a letter when its hash is divisible by this; 0 leaves all runs as they are.
DROP_EVERY = 31
#: Parts of the dimensions, each hashed to so many bits; all parts of a word are one number.
PARTS, PART_BITS, DISTANCE = 4, 16, 2
#: Distinct words that a task holds before it sends their counts on.
HELD_WORDS = 200_000

PART = (1 << PART_BITS) - 1
SUBSETS = [sum(1 << i for i in parts) for parts in combinations(range(PARTS), PARTS - DISTANCE)]

# Letters of runs, A-Z lower-cased, as single bytes of Latin-1; all other bytes become a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points and their occurrences in whole texts.

    Where ``drop_every`` divides the crc32 h of "id:run", all occurrences of the run in the
    document lose their code point h modulo length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(r for r in runs(text or "") if len(r) >= shortest).items():
                    if drop_every:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                        if h % drop_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                    total[run] = total.get(run, 0) + n
                if len(total) >= HELD_WORDS:
                    yield flush()
        yield flush()

    texts = docs.select(col(id_col).cast("string").alias("name"), col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Dimensions(dict):
    """Part and random value of the i-th occurrence of a letter."""

    def __missing__(self, key: tuple[str, int]) -> tuple[int, int]:
        letter, i = key
        value = self[key] = ((ord(letter) + 3 * i) % PARTS, xxhash.xxh3_64_intdigest(f"{letter}{i}"))
        return value


def part_hashes(words: list[str]) -> np.ndarray:
    """The hashes of all parts of the letter multiset of each word, in one number."""
    dimensions, out = _Dimensions(), []
    for word in words:
        parts, seen = [0] * PARTS, {}
        for letter in word:
            i = seen[letter] = seen.get(letter, -1) + 1
            part, value = dimensions[letter, i]
            parts[part] += value
        out.append([p & 0xFFFFFFFFFFFFFFFF for p in parts])
    hashed = mix(np.array(out, np.uint64).reshape(len(words), PARTS)) >> np.uint64(64 - PART_BITS)
    return (hashed << (np.arange(PARTS, dtype=np.uint64) * np.uint64(PART_BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _parts(words: DataFrame) -> DataFrame:
    """(word, n, parts, size) of each word."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            columns = [*batch.columns, pa.array(part_hashes(found)), pa.array([len(w) for w in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "parts", "size"])

    return words.select("word", "n").mapInArrow(hashed, "word string, n long, parts long, size int")


def _bits(subset: int) -> int:
    """The bits of the parts of a subset, as a signed number of 64 bits."""
    bits = sum(PART << (PART_BITS * i) for i in range(PARTS) if subset >> i & 1)
    return bits - (1 << 64) if bits >> 63 else bits


def _signatures(parts: DataFrame) -> DataFrame:
    """A row for each word, signature and half; words with the same ``key`` and ``tag`` are candidates.

    A word meets those of its length and of one more on one size of half, those of a length
    less on another; of an odd length both sizes are the same.
    """
    size = F.col("size")
    halves = F.array_distinct(F.array(F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")))
    halved = parts.select("*", F.explode(halves).alias("half"))
    pieces = F.array(F.substring("word", F.lit(1), F.col("half")), F.substring("word", -F.col("half"), F.col("half")))
    sided = halved.select("*", F.posexplode(pieces).alias("side", "piece"))
    subsets = F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(_bits(s)).alias("bits")) for s in SUBSETS])).alias("s")
    signed = sided.select("*", subsets)
    tag = F.col("s.subset") + F.lit(1 << PARTS) * F.col("side") + F.lit(2 << PARTS) * F.col("half")
    return signed.select(F.xxhash64(F.col("parts").bitwiseAND(F.col("s.bits")), tag, "piece").alias("key"), tag.alias("tag"), "parts", "size", "word", "n")


def _first_shared() -> Column:
    """No part outside of the signature, but before its last one, agrees: earlier signatures are not shared."""
    differ, subset = F.col("x.parts").bitwiseXOR(F.col("y.parts")), F.col("x.tag").bitwiseAND(F.lit((1 << PARTS) - 1))
    found = F.lit(True)
    for i in range(PARTS):
        inside = subset.bitwiseAND(F.lit(1 << i)) != 0
        behind = subset < F.lit(1 << i)
        found = found & (inside | behind | (differ.bitwiseAND(F.lit(_bits(1 << i))) != 0))
    return found


def _pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), once for each pair of words one edit apart.

    The join compares the words of a key one by one and returns only pairs that are one edit
    apart; adaptive execution splits a key of many words. Both sides read the same columns,
    so that they share one shuffle.
    """
    signed = _signatures(stage(_parts(words)))
    x, y = signed.alias("x"), signed.alias("y")
    alike = (F.col("x.key") == F.col("y.key")) & (F.col("x.tag") == F.col("y.tag"))
    half, first_half = F.shiftright("x.tag", PARTS + 1), F.col("x.tag").bitwiseAND(F.lit(1 << PARTS)) == 0
    sizes = (F.abs(F.col("x.size") - F.col("y.size")) <= 1) & (half == F.floor(F.least("x.size", "y.size") / 2))
    once = first_half | (F.substring("x.word", F.lit(1), half) != F.substring("y.word", F.lit(1), half))
    near = _first_shared() & once & (F.levenshtein("x.word", "y.word", 1) == 1)
    met = x.join(y, alike & sizes & (F.col("x.word") < F.col("y.word")) & near)
    return met.select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of ``forms``; counts grow along forms, so there is no cycle.

    Every round doubles the steps taken; the chain is at most as long as the logarithm of
    the largest count.
    """
    reached = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
        reached = moved.select("word", "root")
        if moved.where("more").isEmpty():
            return reached


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    least_count: int = LEAST_COUNT,
    form_times: int = FORM_TIMES,
    drop_every: int = DROP_EVERY,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least ``least_count`` occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of the whole texts, only A-Z
    lower-cased, of at least ``shortest`` code points after the loss of letters described at
    ``word_counts``. Two words are near if one inserted, deleted or replaced code point makes
    one of them the other; ``n_near`` counts them. The form is the near word with the largest
    n (the first in code-point order of equals) if that is ``form_times`` the word's own, and
    ``root`` the last word reached over forms, or the word itself.

    Null and empty texts have no words. A row without an id counts with an empty one. Rows
    that repeat an id, and repeated rows, all count. An empty table gives an empty table.
    Other columns, whatever their names, are not read.
    """
    words = stage(word_counts(docs, id_col, text_col, shortest, drop_every).where(F.col("n") >= least_count))
    pairs = stage(_pairs(words))
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"), F.first("n").alias("n"))
    far = -F.col("b.less") >= form_times * F.col("n")
    judged = stage(best.select("word", "n_near", F.when(far, F.col("b.near")).alias("form"), F.when(far, -F.col("b.less")).alias("form_n")))
    roots = _roots(judged.where("form is not null"))
    found = words.join(judged, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
