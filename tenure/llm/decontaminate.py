"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence that occurs inside one item. Training words are
streamed through it; the longest match that ends at each word tells which words lie in a
window of an item. Items are dealt to blocks of bounded size by a hash, so that what a task
holds does not grow with the benchmark; more blocks mean more passes over the documents. The
automaton of a block is built in a task and staged as plain data.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import col, extended, others
from tenure.session import stage

WINDOW = 10
#: Words of items in one automaton (in expectation; one item is never divided), and automata
#: held by a task at a time.
BLOCK_WORDS, BLOCKS_AT_ONCE = 200_000, 2
#: Documents with this share of hit words are dropped instead of cut.
MOST_COVERAGE = 0.5
SPAN = "struct<first_word:long,last_word:long,start:long,end:long>"
PRODUCED = ("n_words", "n_hit", "item_ids", "spans")

# Bytes that belong to words after lower-casing A-Z; all others become a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, numbers in numbered:
            last = 0
            for number in numbers:
                last = self._extend(last, number)
        # State of the window that ends here, for matches of at least the window's length.
        self.window_state = []
        for state in range(len(self.length)):
            at = state
            while at > 0 and self.length[self.link[at]] >= window:
                at = self.link[at]
            self.window_state.append(at if self.length[at] >= window else -1)
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, numbers in numbered:
            state = 0
            for i, number in enumerate(numbers):
                state = self.next[state][number]
                if i + 1 >= window:
                    self.items.setdefault(self.window_state[state], set()).add(name)
            if len(numbers) < window:
                self.short.setdefault(state, []).append((len(numbers), name))
        self.has_short = [False] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.has_short[state] = state in self.short or (state > 0 and self.has_short[self.link[state]])
        self.shortest = min([window, *(len(n) for _, n in numbered)])

    def to_bytes(self) -> bytes:
        """Plain lists and dictionaries, which any Python process can read."""
        return pickle.dumps(self.__dict__)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        automaton = cls.__new__(cls)
        automaton.__dict__.update(pickle.loads(data))
        return automaton

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, state: int, target: int, number: int) -> int:
        """State of the longest string of ``state`` followed by ``number``."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(number) == target:
            self.next[state][number] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, number: int) -> int:
        if number in self.next[last]:
            return self._split(last, self.next[last][number], number)
        fresh = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and number not in self.next[at]:
            self.next[at][number] = fresh
            at = self.link[at]
        if at >= 0:
            self.link[fresh] = self._split(at, self.next[at][number], number)
        return fresh

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[str | None]) -> None:
        """Mark the words inside windows in ``hit`` and add the items of the windows to ``found``."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], (numbers >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2]
        enough = ends - starts >= self.shortest
        moves, link, length, window = self.next, self.link, self.length, self.window
        for start, end in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            state = matched = 0
            for i, number in enumerate(numbers[start:end].tolist(), start):
                after = moves[state].get(number)
                while after is None and state:
                    state = link[state]
                    matched = length[state]
                    after = moves[state].get(number)
                if after is None:
                    continue
                state, matched = after, matched + 1
                if matched >= window:
                    hit[i - window + 1 : i + 1] = True
                    found |= self.items[self.window_state[state]]
                if self.has_short[state]:
                    at = state
                    while at > 0:
                        for size, name in self.short.get(at, ()):
                            if size <= matched:
                                hit[i - size + 1 : i + 1] = True
                                found.add(name)
                        at = link[at]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _automata(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(block, automaton): one automaton for each block of items, built in a task."""
    items = benchmark.select(col(item_col).cast("string").alias("name"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("body"))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(body)) for body in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    total = items.select("body").mapInArrow(size, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))

    def build(rows: pa.Table) -> pa.Table:
        held = sorted(zip(rows["name"].to_pylist(), rows["body"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        automaton = Automaton([(name, words_of(body)) for name, body in held], window)
        return pa.table({"block": rows["block"][:1], "automaton": pa.array([automaton.to_bytes()], pa.large_binary()).cast(pa.binary())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)).cast("int"))
    return stage(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"))


class _Held:
    """Automata of one pass, rebuilt from broadcast bytes where they are used."""

    def __init__(self, parts: list) -> None:
        self.parts = parts

    def open(self) -> list[Automaton]:
        return [Automaton.from_bytes(part.value) for part in self.parts]

    def release(self) -> None:
        for part in self.parts:
            part.unpersist()


def _passes(automata: DataFrame) -> Iterator[_Held]:
    """Broadcast bytes of the automata, a bounded number for each pass; read one block at a time."""
    context = automata.sparkSession.sparkContext
    numbers = sorted(r["block"] for r in automata.select("block").collect())

    def of(number: int):
        return context.broadcast(bytes(automata.where(F.col("block") == number).first()["automaton"]))

    if not numbers:
        yield _Held([])
    for i in range(0, len(numbers), BLOCKS_AT_ONCE):
        yield _Held([of(number) for number in numbers[i : i + BLOCKS_AT_ONCE]])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Add what each text shares with the benchmark: ``n_words``, ``n_hit``, ``item_ids``, ``spans``.

    Words are runs of ASCII letters and digits and of any other code points from 128 on,
    A-Z lower-cased. A window is ``window`` consecutive words of an item; an item with
    fewer words, but not none, is one window. A word is hit inside any occurrence of a
    window. ``item_ids`` are the items with occurring windows, as sorted strings without
    nulls; ``spans`` are the maximal runs of hit words with byte offsets in UTF-8.

    A null or empty text has no words; items without words match nothing; an item
    without an id still hits words. Repeated rows are judged alike. An empty benchmark
    hits nothing, an empty table gives an empty table. Columns named like a produced one
    are replaced.
    """
    passed = others(docs, *PRODUCED)
    schema = extended(docs, passed, f"n_words long, n_hit long, item_ids array<string>, spans array<{SPAN}>")
    span_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")]))
    at = passed.index(next(c for c in passed if c.lower() == text_col.lower()))
    out = docs.select(*[col(c) for c in passed])
    for number, held in enumerate(_passes(_automata(benchmark, item_col, item_text_col, window))):
        later = number > 0

        def scan(batches: Iterator[pa.RecordBatch], held: _Held = held, later: bool = later) -> Iterator[pa.RecordBatch]:
            automata = held.open()
            for batch in batches:
                n_words, n_hit, names, spans = [], [], [], []
                before = zip(*(batch.column(len(passed) + i).to_pylist() for i in (2, 3)), strict=True) if later else None
                for text in batch.column(at).cast(pa.binary()).to_pylist():
                    words = words_of(text or b"")
                    hit, found = np.zeros(len(words), bool), set()
                    for automaton in automata:
                        automaton.scan(words, hit, found)
                    if before is not None:
                        known, runs = next(before)
                        found.update(known)
                        for run in runs:
                            hit[run["first_word"] : run["last_word"] + 1] = True
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    names.append(sorted(x for x in found if x is not None))
                    if n_hit[-1]:
                        places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
                        spans.append([{"first_word": a, "last_word": b - 1, "start": places[a][0], "end": places[b - 1][1]} for a, b in _runs(hit)])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(passed)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, span_type)],
                    names=[*passed, *PRODUCED],
                )

        out = (stage(out) if later else out).mapInArrow(scan, schema)
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    most_coverage: float = MOST_COVERAGE,
) -> DataFrame:
    """Cut the hit spans out of every text; drop rows of which at least ``most_coverage`` of the words is hit.

    A cut text is scanned again until nothing is hit, since a cut can bring the two ends of a
    window together; with several passes, texts that a round has cut take part in another
    one. Other rows come back as they are. Edge cases are those of ``find_contamination``; the
    columns of ``docs`` are returned.
    """
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    names, width = docs.columns, len(docs.columns)
    schema = extended(docs, names, "__words long, __cut long, __before long")
    automata = _automata(benchmark, item_col, item_text_col, window)
    several = automata.count() > BLOCKS_AT_ONCE
    kept = (F.col("__cut") == 0) | (F.col("__cut") < most_coverage * F.col("__words"))
    out = docs.select(*[col(c) for c in names], F.lit(-1).cast("long").alias("__words"), *[F.lit(0).cast("long").alias(c) for c in ("__cut", "__before")])
    settled: list[DataFrame] = []
    while True:
        for held in _passes(automata):

            def cut(batches: Iterator[pa.RecordBatch], held: _Held = held) -> Iterator[pa.RecordBatch]:
                opened = held.open()
                for batch in batches:
                    texts = batch.column(at).cast(pa.binary()).to_pylist()
                    n_words, n_cut = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
                    for i, text in enumerate(texts):
                        words = words_of(text or b"")
                        if n_words[i] < 0:
                            n_words[i] = len(words)
                        while words:
                            hit = np.zeros(len(words), bool)
                            for automaton in opened:
                                automaton.scan(words, hit, set())
                            if not hit.any():
                                break
                            n_cut[i] += int(hit.sum())
                            places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
                            for a, b in reversed(_runs(hit)):
                                text = text[: places[a][0]] + text[places[b - 1][1] :]
                            texts[i], words = text, words_of(text)
                    columns = list(batch.columns)
                    columns[at : at + 1] = [pa.array(texts, pa.binary()).cast(pa.string())]
                    columns[width : width + 2] = [pa.array(n_words, pa.int64()), pa.array(n_cut, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "__words", "__cut", "__before"])

            out = out.mapInArrow(cut, schema)
            if several:
                out = stage(out)
                held.release()
        if not several:
            settled.append(out)
            break
        settled.append(out.where("__cut = __before"))
        out = out.where("__cut > __before").withColumn("__before", F.col("__cut"))
        if out.isEmpty():
            break
    return reduce(DataFrame.unionAll, settled).where(kept).select(*[col(c) for c in docs.columns])
