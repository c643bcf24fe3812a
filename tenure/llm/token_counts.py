"""Token counts of fields and sections from one encoding of the whole document.

The fields of a document are joined and encoded once; the byte length of every token maps
it back to its place in the text, and an interval join of token and section spans counts
the tokens of each section. Encoding sections apart would give other tokens at their
borders. A token that crosses a border is allocated by an explicit rule: "start", to the
section that holds its first byte, or "most", to the section that holds most of its bytes
(the first of equals).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import col, extended, others

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern that belongs to the vocabulary (fixed value of its public format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIELD_BREAK = "\n\n"
SECTION = "struct<field:string,start:long,end:long,tokens:long>"
PRODUCED = ("n_tokens", "n_sections", "n_crossing", "sections")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def section_edges(fields: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """Byte offsets where sections start in the joined text, and the field of each.

    A section is a line with its line end; the break after a field belongs to its last
    section. An empty field has one section without bytes.
    """
    starts, owners, at = [], [], 0
    for k, body in enumerate(fields):
        line = 0
        while True:
            starts.append(at + line)
            owners.append(k)
            line = body.find(b"\n", line) + 1
            if line == 0 or line == len(body):
                break
        at += len(body) + (len(FIELD_BREAK) if k + 1 < len(fields) else 0)
    return starts, owners


def allocate(token_ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a border."""
    if not len(token_ends):
        return np.zeros(len(starts), np.int64), 0
    begins = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    chosen = first.copy()
    if rule == "most":
        for i in np.flatnonzero(last > first):
            cuts = np.concatenate(([begins[i]], starts[first[i] + 1 : last[i] + 1], [token_ends[i]]))
            chosen[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(chosen, minlength=len(starts)), int((last > first).sum())


def count_tokens(docs: DataFrame, fields: Sequence[str] = ("text",), rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``n_tokens``, ``n_sections``, ``n_crossing`` and ``sections`` to every row.

    ``sections`` has, in order, the field, the span in code points of the joined text and
    the tokens of every section; they add up to ``n_tokens``. Texts of special tokens are
    ordinary text. Null fields count as empty; an empty document has one section without
    tokens for each field. Long texts are encoded whole. Repeated rows are counted alike,
    an empty table gives an empty table. Columns named like a produced one are replaced.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    passed = others(docs, *PRODUCED)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    width, names = len(passed), list(fields)
    kinds = pa.list_(pa.struct([("field", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())]))
    rows = docs.select(*[col(c) for c in passed], *[F.coalesce(col(f).cast("string"), F.lit("")).alias(f"__field{k}") for k, f in enumerate(names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        sizes = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, rank in ranks.value.items():
            sizes[rank] = len(token)
        for batch in batches:
            totals, crossing, sections = [], [], []
            for parts in zip(*(batch.column(width + k).to_pylist() for k in range(len(names))), strict=True):
                text = FIELD_BREAK.join(parts)
                starts, owners = section_edges([p.encode() for p in parts])
                ends = np.cumsum(sizes[np.array(encoding.encode_ordinary(text), np.int64)])
                found, across = allocate(ends, np.array(starts, np.int64), rule)
                body = np.frombuffer(text.encode(), np.uint8)
                points = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
                spans = points[np.array([*starts, len(body)])].tolist()
                totals.append(len(ends))
                crossing.append(across)
                sections.append([{"field": names[o], "start": a, "end": b, "tokens": n} for o, a, b, n in zip(owners, spans[:-1], spans[1:], found.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(totals, pa.int64()), pa.array([len(s) for s in sections], pa.int64()), pa.array(crossing, pa.int64()), pa.array(sections, kinds)],
                names=[*passed, *PRODUCED],
            )

    return rows.mapInArrow(count, extended(docs, passed, f"n_tokens long, n_sections long, n_crossing long, sections array<{SECTION}>"))
