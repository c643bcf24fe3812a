"""Secret scan: candidates by form, and a random forest that removes false positives.

Candidates are long runs of token characters that are not plain words, whatever is assigned
to a name of credentials, and passwords in urls. The forest sees their length, character
transitions, how far words of the corpus cover them, the path of the document and the words
before and after. It learns from labelled findings of several kinds. Each kind is known by
some evidence (a name in front, a form); a finding is learnt twice, as it is and without
that evidence, so that the forest has to find what else tells the kinds apart. The
dictionary of corpus words is counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import col
from tenure.session import stage

SHORTEST = 16
#: Most frequent words of the corpus that count as dictionary, and their shortest length.
DICTIONARY_WORDS, DICTIONARY_LETTERS = 5_000, 3
#: Bound of the labelled findings that the forest is fitted on, of each kind.
TRAINING_ROWS = 20_000
TREES, TREE_DEPTH, SEED = 30, 6, 17
#: Bytes before and after a candidate that hold its neighbouring words.
CONTEXT = 48
LIKELY = 0.5
FINDING = "finding string, start long, before string, after string, path string, features array<double>"

_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
# The password of a user in a url.
_IN_URL = re.compile(rb"://[^\s/:@\"']{1,64}:([^\s/@\"']{1,256})@")
#: Capital letters that make a run without digits a candidate.
CAPITALS = 4
_WORD = re.compile(rb"[A-Za-z]+")
_HINTS = [b"token", b"key", b"secret", b"password", b"passwd", b"auth", b"credential", b"bearer", b"private", b"pwd", b"passphrase"]
# A name that holds one of the hints, and what is assigned to it: quoted, or up to white space
# (without a comma or semicolon at its end). A quoted value is looked at only, as it may
# hold another name; an author is no name of credentials.
_ASSIGNED = re.compile(
    rb"(?i:%s)[\w.-]{0,64}[\"'`\]]{0,2}[ \t]*(?::[ \t]*[a-zA-Z_][\w.\[\]]{0,64}[ \t]*=|=>|:=|={1,3}|:)(?:\s*(?i:bearer|basic|token)[ \t]+)?"
    rb"(?:(?=\s*\"(?P<double>(?:\\.|[^\"\\\r\n])+)\")|(?=\s*'(?P<single>(?:\\.|[^'\\\r\n])+)')|(?=\s*`(?P<back>[^`\r\n]+)`)"
    rb"|[ \t]*[\"'`]?(?P<bare>[^\s\"'`]\S*))" % b"|".join(_HINTS).replace(b"auth", b"auth(?!or(?!i))")
)
_DOUBTS = [b"example", b"sample", b"test", b"dummy", b"hash", b"sha", b"md", b"uuid", b"id", b"commit", b"phone", b"card", b"account", b"order", b"number"]
_PATHS = [b"test", b"example", b"doc", b"config", b"env", b"src"]
FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "hex_only", "digits_only", "entropy", "distinct", "transitions", "longest_run", "rare_pairs",
    "dictionary", "path_depth", "assigned", "quoted", "hint_distance", "doubt_distance", "closed",
    *(f"path_{p.decode()}" for p in _PATHS),
]


def _kind(byte: int) -> int:
    return 0 if 48 <= byte <= 57 else 1 if 65 <= byte <= 90 else 2 if 97 <= byte <= 122 else 3


def _covered(text: bytes, dictionary: frozenset[bytes]) -> float:
    """Share of the bytes that the longest matching words cover, from left to right."""
    low, at, covered = text.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), DICTIONARY_LETTERS - 1, -1):
            if low[at : at + size] in dictionary:
                covered, at = covered + size, at + size
                break
        else:
            at += 1
    return covered / len(low)


def _distance(words: list[bytes], wanted: list[bytes]) -> float:
    """Words between the candidate and the nearest wanted one; 9 without any."""
    return float(next((i for i, w in enumerate(words) if w in wanted), 9))


def describe(value: bytes, before: bytes, after: bytes, path: bytes, dictionary: frozenset[bytes]) -> list[float]:
    kinds = [_kind(c) for c in value]
    n, counts = len(value), Counter(value)
    runs = re.findall(rb"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+", value)
    near = before.rstrip()
    quoted = near[-1:] in (b'"', b"'", b"`")
    left = [w.lower() for w in _WORD.findall(before)][::-1][:4]
    right = [w.lower() for w in _WORD.findall(after)][:2]
    rare = sum(a in (0, 3) or b in (0, 3) for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    low = path.lower()
    return [
        float(n), *(kinds.count(k) / n for k in range(4)), float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None), float(value.isdigit()),
        -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts) / n, (len(runs) - 1) / max(1, n - 1), max(map(len, runs)) / n, rare,
        _covered(value, dictionary), float(low.count(b"/")), float(near.rstrip(b"\"'`").rstrip()[-1:] in (b"=", b":")), float(quoted),
        _distance(left, _HINTS), min(_distance(left, _DOUBTS), _distance(right, _DOUBTS)), float(after[:1] in (b'"', b"'", b"`", b";", b",")),
        *(float(p in low) for p in _PATHS),
    ]


def candidate_spans(text: bytes) -> list[tuple[int, int]]:
    """Places of all candidates in order; a run may hold an assigned value or lie in one."""
    runs = {m.span() for m in _CANDIDATE.finditer(text) if any(48 <= c <= 57 for c in m[0]) or sum(65 <= c <= 90 for c in m[0]) >= CAPITALS}
    runs |= {m.span(1) for m in _IN_URL.finditer(text)}
    assigned = {(m.start(k), m.start(k) + len(m[k].rstrip(b",;") if k == "bare" else m[k])) for m in _ASSIGNED.finditer(text) for k in (m.lastgroup,)}
    return sorted(span for span in runs | assigned if span[0] < span[1])


def corpus_words(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of letters over all documents (ties by the word)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(w for w in (text or b"").lower().split() if DICTIONARY_LETTERS <= len(w) <= 12 and w.isascii() and w.isalpha())
            if len(held) > 500_000:
                yield sent()
                held.clear()
        yield sent()

    counted = docs.select(col(text_col).cast("binary").alias("body")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


def find_candidates(docs: DataFrame, dictionary: list[str], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, ``finding``, ``start`` (code points), neighbouring text, path and features.

    Null texts have no candidates, a null path is empty. Every candidate of a text is
    returned, however long the text.
    """
    known = docs.sparkSession.sparkContext.broadcast(frozenset(w.encode() for w in dictionary))
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("body"), F.coalesce(col(path_col).cast("string"), F.lit("")).alias("path"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                points, seen = 0, 0
                for start, end in candidate_spans(text or b""):
                    value, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
                    points += len(text[seen:start].decode("utf-8", "ignore"))
                    seen = start
                    at.append(i)
                    out.append((value.decode("utf-8", "replace"), points, before.decode("utf-8", "ignore"), after.decode("utf-8", "ignore"), path, describe(value, before, after, path.encode(), known.value)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["id", "finding", "start", "before", "after", "path", "features"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, {FINDING}").withColumnRenamed("id", id_col)


#: Kinds of labelled findings: name, label, condition, and the features that hold its evidence.
_HASH_OF = r"(?i)(commit|revision|sha-?[0-9]*|md5|checksum|digest|etag)[\s:=\"'`#]*$"
_NAMED = r"(?i)(token|key|secret|password|passwd|pwd|passphrase)[A-Za-z0-9_]*[\"'`]?\s*(=|:|=>|:=)\s*"
_QUOTE = "[\"'`]"


def _before(pattern: str) -> Column:
    return F.col("before").rlike(pattern)


KINDS = [
    ("quoted after a name", 1, lambda: _before(_NAMED + _QUOTE + "$") & F.col("after").rlike("^" + _QUOTE), ["assigned", "quoted", "hint_distance", "closed"]),
    ("bare after a name", 1, lambda: _before(_NAMED + "$") & (F.length("finding") >= 8), ["assigned", "hint_distance"]),
    ("password in a url", 1, lambda: _before("://[^ /:@]+:$") & F.col("after").startswith("@"), []),
    ("digits", 0, lambda: F.col("finding").rlike("^[0-9]+$"), ["digits_only", "digits", "lower"]),
    ("uuid", 0, lambda: F.col("finding").rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), ["symbols", "length"]),
    ("hash of something", 0, lambda: F.col("finding").rlike("(?i)^[0-9a-f]{32,128}$") & _before(_HASH_OF), ["doubt_distance", "assigned"]),
    ("words in a row", 0, lambda: F.col("finding").rlike("^[a-z]+([-_/][a-z0-9]+){2,}$"), ["dictionary", "symbols"]),
]
#: Values of a feature that tell nothing.
NEUTRAL = {"hint_distance": 9.0, "doubt_distance": 9.0}


def evidence() -> Column:
    """The first kind that a finding belongs to: its ``label`` and the numbers of the features that hold its evidence."""
    kind = F.lit(None).cast("struct<label:int,hidden:array<int>>")
    for _, label, condition, hidden in reversed(KINDS):
        places = F.array(*[F.lit(FEATURES.index(f)) for f in hidden]).cast("array<int>")
        kind = F.when(condition(), F.struct(F.lit(label).alias("label"), places.alias("hidden"))).otherwise(kind)
    return kind


def labelled_by_kind() -> Column:
    """Labels from the documents themselves: 1 for values of credential names and passwords in urls, 0 for
    numbers, uuids, hashes of something and words in a row; none for the rest."""
    return evidence()["label"]


def without_evidence(features: Column, hidden: Column) -> Column:
    """The features with those in ``hidden`` set to values that tell nothing."""
    neutral = F.array(*[F.lit(NEUTRAL.get(f, 0.0)) for f in FEATURES])
    return F.transform(features, lambda x, i: F.when(F.array_contains(hidden, i), F.get(neutral, i)).otherwise(x))


def fit_forest(findings: DataFrame, label: Column, id_col: str = "doc_id") -> RandomForestClassificationModel | None:
    """Forest on labelled findings (label 1: secret, 0: false positive, null: not labelled).

    A finding is learnt as it is and without the evidence of its kind (``evidence``). At most
    ``TRAINING_ROWS`` of each label are expected to be used, chosen by a hash of document and
    place. None without findings of both labels.
    """
    hidden = F.coalesce(evidence()["hidden"], F.array().cast("array<int>"))
    both = F.array(F.col("features"), without_evidence(F.col("features"), hidden))
    known = findings.select(label.cast("double").alias("label"), F.explode(both).alias("features"), F.xxhash64(col(id_col), F.col("start")).alias("h"))
    known = stage(known.where("label is not null"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes.get(0.0) or not sizes.get(1.0):
        return None
    wanted = F.lit(False)
    for kind in (0.0, 1.0):
        share = min(1.0, 2 * TRAINING_ROWS / sizes[kind])
        wanted = wanted | ((F.col("label") == kind) & (F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)))
    # Both labels weigh the same, however many findings each has.
    weight = F.when(F.col("label") == 1, 1 / sizes[1.0]).otherwise(1 / sizes[0.0]) * (sizes[0.0] + sizes[1.0]) / 2
    rows = known.where(wanted).select("label", array_to_vector("features").alias("vector"), weight.alias("weight"))
    return RandomForestClassifier(labelCol="label", featuresCol="vector", weightCol="weight", numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED).fit(rows)


def judge(findings: DataFrame, forest: RandomForestClassificationModel | None, likely: float = LIKELY) -> DataFrame:
    """Add ``score`` (share of the forest's votes for a secret) and ``is_secret`` to findings.

    Without a forest nothing is removed: the score is 1.
    """
    if forest is None:
        scored = findings.withColumn("score", F.lit(1.0))
    else:
        scored = forest.transform(findings.withColumn("__vector", array_to_vector("features")).withColumnRenamed("__vector", "vector"))
        scored = scored.withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= likely)


def scan(docs: DataFrame, labelled: Column | None = None, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Findings of ``docs`` with ``score`` and ``is_secret``; see the functions above for edge cases.

    ``labelled`` is an expression over the findings (default: ``labelled_by_kind``),
    ``training`` a condition on the documents whose labels may be learnt. Only the named
    columns of ``docs`` are read; an empty table gives an empty table.
    """
    words = corpus_words(docs, text_col)
    findings = stage(find_candidates(docs, words, id_col, text_col, path_col))
    label = labelled_by_kind() if labelled is None else labelled
    forest = fit_forest(findings if training is None else findings.where(training), label, id_col)
    return judge(findings, forest)
