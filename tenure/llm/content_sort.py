"""Exact dedup by sorting contents; DataFrame functions only.

``repartitionByRange`` samples splitters and range-partitions the normalised text,
the sort-based aggregate sorts each range externally and compares neighbouring texts
in full, keeping the smallest identifier. A text that a bounded sample shows to be
frequent is dealt over several runs by a salt of the identifier; runs of one text meet
again through the SHA-256 of the whole content. Salting only spreads work: any choice
of frequent texts gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import WHITE, col, others
from tenure.session import stage

#: Rows sampled to find frequent texts, and the hits that make one frequent. At most
#: SAMPLE_ROWS / HITS hashes come to the driver, whatever the input.
SAMPLE_ROWS, HITS = 20_000, 10
#: A frequent text gets one run for so many rows of the table.
ROWS_PER_RUN = 20_000
SPLITTER_CHARS = 32
PRODUCED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row.

    Texts are equal when they are identical after each run of ASCII white space became
    one space; the smallest id of a group stays. Null and empty texts are equal. Rows
    that repeat the kept id are copies of the kept row and are marked kept too; all
    count in ``group_size``. A null id sorts last: it is kept (``keep_id`` null) only
    where the group has no id. An empty table gives an empty table. Columns named like
    a produced one are replaced.
    """
    passed = others(docs, *PRODUCED)
    rows = docs.count()
    content = docs.select(col(id_col).alias("id"), normalised(col(text_col)).alias("content"))
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    frequent = [
        r["h"]
        for r in content.sample(share, seed=7).groupBy(F.xxhash64("content").alias("h")).count().where(F.col("count") >= HITS).select("h").collect()
    ]
    salt = F.lit(0)
    if frequent:
        runs = max(16, rows // ROWS_PER_RUN)
        salt = F.when(F.xxhash64("content").isin(frequent), F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int")).otherwise(F.lit(0))
    # A struct as minimum makes the aggregate sort-based: neighbours are compared, and a run never sits in memory.
    smallest = F.min(F.struct(F.col("id").isNull().alias("missing"), F.col("id")))
    # Splitters come to the driver, so they are taken from the first characters and a hash, not from whole texts.
    range_key = [F.substring("content", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("content").alias("tail")]
    placed = content.select("id", "content", salt.alias("salt"), *range_key).repartitionByRange("head", "tail", "salt")
    runs_ = placed.groupBy("head", "tail", "salt", "content").agg(smallest.alias("least"), F.count(F.lit(1)).alias("n"))
    runs_ = runs_.select(F.sha2("content", 256).alias("sha"), "least", "n")
    groups = stage(runs_.groupBy(F.col("sha").alias("text_sha256")).agg(F.min("least").alias("__least"), F.sum("n").alias("group_size")))
    marked = docs.select(*[col(c) for c in passed], F.sha2(normalised(col(text_col)), 256).alias("text_sha256"))
    return marked.join(groups, "text_sha256", "left").select(
        *[col(c) for c in passed],
        F.col("__least.id").alias("keep_id"),
        "group_size",
        col(id_col).eqNullSafe(F.col("__least.id")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that stay, one per text; rows repeating the kept id are reduced to one."""
    kept = mark_copies(docs, id_col, text_col).where("kept").dropDuplicates(["text_sha256"])
    return kept.select(*[col(c) for c in docs.columns])
