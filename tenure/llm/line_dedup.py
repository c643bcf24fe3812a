"""Line dedup with two Bloom filters; only suspected repeats are shuffled.

Pass 1 puts the hash of every line key of every document into the filters of
``seen_twice``. Pass 2 sends only the keys whose bits were all seen twice; grouping by
the whole key confirms real repeats and finds the smallest document holding each. Pass 3
drops the lines by (document, key).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm import seen_twice
from tenure.llm.common import NO_ID, col, extended, others
from tenure.session import stage

SHORTEST = 10
PRODUCED = ("n_lines", "n_dropped")
#: Lines of a document that the filter size expects; more only lets more keys pass the test.
LINES_EXPECTED = 16


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def long_enough(key: bytes, shortest: int) -> bool:
    """At least ``shortest`` code points; bytes decide unless the key is short."""
    if len(key) < shortest or len(key) >= 4 * shortest:
        return len(key) >= shortest
    return len(key.decode("utf-8", "replace")) >= shortest


def document_keys(text: bytes | None, shortest: int) -> list[bytes]:
    """Distinct line keys of one text that are long enough to be judged."""
    keys = {line_key(line) for line in (text or b"").split(b"\n")}
    return [k for k in keys if long_enough(k, shortest)]


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Drop lines whose key occurs in several documents, except in the smallest one.

    The key is the line without ASCII white space at its ends and with A-Z lower-cased;
    keys of fewer than ``shortest`` code points are never judged. Returns every row with
    its columns, the remaining lines as text, ``n_lines`` (before) and ``n_dropped``.

    A null or empty text is one empty line and comes back as ''. Rows that repeat an id
    are one document. Rows without an id form one document that sorts last. An empty
    table gives an empty table. Columns named like a produced one are replaced. Ids are whole
    numbers; the names of the id and text columns are compared without case, and the text
    column keeps its name and place.
    """
    spark = docs.sparkSession
    text_col = next(c for c in docs.columns if c.lower() == text_col.lower())
    passed = others(docs, text_col, *PRODUCED)
    lines = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), col(text_col).cast("binary").alias("body"))
    bits = seen_twice.bits_for(docs.count(), LINES_EXPECTED)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = seen_twice.Collector(bits)
        for batch in batches:
            yield from sink.add(_hashes([k for text in batch.column(0).to_pylist() for k in document_keys(text, shortest)]))
        yield from sink.flush()

    twice = spark.sparkContext.broadcast(seen_twice.merged(lines.select("body").mapInArrow(collect, seen_twice.SCHEMA), bits))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in document_keys(text, shortest)]
            near = seen_twice.maybe_twice(_hashes([k for _, k in found]), twice.value, bits)
            kept = [found[j] for j in np.flatnonzero(near)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in kept], pa.int64()), pa.array([k for _, k in kept], pa.binary())], names=["id", "line_key"]
            )

    suspects = stage(lines.mapInArrow(suspect, "id long, line_key binary"))
    repeats = suspects.groupBy("line_key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    drops = (
        suspects.join(stage(repeats.select("line_key", "first_id")), "line_key")
        .where("id > first_id")
        .mapInArrow(_digests, "id long, line_digest binary")
        .groupBy("id")
        .agg(F.collect_set("line_digest").alias("line_digests"))
    )
    rows = docs.select(*[col(c) for c in passed], lines_of(text_col).alias("__body"), F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"))
    joined = rows.join(drops.withColumnsRenamed({"id": "__id", "line_digests": "__drops"}), "__id", "left").select(*[col(c) for c in passed], "__body", "__drops")
    width = len(passed)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                parts = text.split(b"\n")
                n_lines.append(len(parts))
                if drop:
                    gone = set(drop)
                    parts = [p for p in parts if _digest(line_key(p)) not in gone]
                n_dropped.append(n_lines[-1] - len(parts))
                texts.append(b"\n".join(parts) if drop else text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*passed, text_col, *PRODUCED],
            )

    out = joined.mapInArrow(apply, extended(docs, passed, f"`{text_col}` string, n_lines long, n_dropped long"))
    return out.select(*[col(c) for c in docs.columns if c in passed or c == text_col], *PRODUCED)


def lines_of(text_col: str):
    return F.coalesce(col(text_col), F.lit("")).cast("binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("line_key")).to_pylist()
        ids = batch.column(batch.schema.get_field_index("id"))
        yield pa.RecordBatch.from_arrays([ids, pa.array([_digest(k) for k in keys], pa.binary())], names=["id", "line_digest"])
