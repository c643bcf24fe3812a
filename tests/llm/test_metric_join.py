import random

import numpy as np
import pytest
from tenure.llm import metric_join
from tenure.llm.components import components


def shingle_set(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed, groups=12):
    """Near copies around bases, chains of edits, shared passages, exact copies and short texts."""
    rng = random.Random(seed)
    passage = [f"p{rng.randrange(50)}" for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "ONE two  three", "one two three four"]
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 30, 60, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8]))))
        chain = base
        for _ in range(rng.randint(0, 4)):
            chain = edited(rng, chain, max(1, len(chain) // 90))
            texts.append(" ".join(chain))
        texts.append(" ".join(base[: len(base) // 2] + passage))
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def linked(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in metric_join.link_documents(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(frame, seed):
    rows = corpus(seed)
    assert linked(frame("doc_id long, text string", rows)) == brute(rows)


def test_any_order_of_pivots_gives_the_same(frame, monkeypatch):
    """A table of counts from every document, and none at all: only the work differs."""
    rows = corpus(3)
    monkeypatch.setattr(metric_join, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(metric_join, "CHANCE", 1)
    assert linked(frame("doc_id long, text string", rows)) == brute(rows)
    monkeypatch.setattr(metric_join, "CHANCE", 10**6)
    assert linked(frame("doc_id long, text string", rows)) == brute(rows)


def test_large_group_of_near_copies(frame):
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 6])))) for i in range(220)]
    assert linked(frame("doc_id long, text string", rows)) == brute(rows)


def test_edge_rows(frame, long_text):
    rows = [(5, long_text), (9, long_text + " tail"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, None), (2, "A b c D e")]
    df = frame("doc_id long, text string, n int, digest string", [(*r, 1, "x") for r in rows])
    out = metric_join.link_documents(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    n = len(shingle_set(long_text))
    want = [(None, 2, None), (2, 2, 2), (5, n, 5), (7, 2, 2), (7, 2, 2), (8, 0, 8), (9, n + 1, 5)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    kept = metric_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 5, 8, None]


def test_empty_table(frame):
    assert metric_join.link_documents(frame("doc_id long, text string", [])).count() == 0
    assert metric_join.drop_near_copies(frame("doc_id long, text string", [])).count() == 0


def test_prefix_holds_a_shared_shingle():
    """Two linked sets share a shingle among the first ones of each, under any order."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = set(range(n))
        y = set(x)
        for v in rng.integers(0, n, 4):
            y.discard(int(v))
            y.add(int(v) + 1000)
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        order = rng.permutation(2000)
        first = [set(sorted(s, key=lambda v: order[v])[: metric_join.prefix_length(len(s), 85)]) for s in (x, y)]
        assert first[0] & first[1]


def test_components_of_long_paths_and_hubs(frame):
    links = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(100, 160)] + [(700, 701), (701, 700), (9, 9)]
    found = {r["id"]: r["component"] for r in components(frame("a long, b long", links)).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in [*range(100, 160), 500])
    assert found[700] == found[701] == 700


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(frame):
    rng = random.Random(12)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (3, " ".join(b)), (4, "other words of a text"), (4, " ".join(a))]
    got = sorted(tuple(r) for r in metric_join.link_documents(frame("doc_id long, text string", rows)).collect())
    assert got == sorted([(1, 57, 1), (1, 57, 1), (2, 58, 1), (3, 58, 1), (3, 57, 1), (4, 2, 4), (4, 57, 1)])


def test_extra_columns_with_the_names_of_inner_ones(frame):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{base} end{i}" if i < 5 else f"text {i} of its own words here", i, "n", 2, None, "x", "y") for i in range(10)]
    df = frame("doc_id long, text string, id int, name string, n int, digest binary, component string, __x string", rows)
    assert sorted(r["component_id"] for r in metric_join.link_documents(df).collect()) == [0] * 5 + list(range(5, 10))
    kept = metric_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, *range(5, 10)]


def test_many_short_texts_with_a_common_start(frame):
    """Two thousand texts that share a shingle and are linked with nothing."""
    rows = [(i, f"one two three four {i} a{i} b{i} c{i} d{i}") for i in range(2000)] + [(5000, "one two three four 7 a7 b7 c7 d7 x"), (5001, "one two three four 7 a7 b7 c7 d7")]
    got = {r[0]: r[2] for r in metric_join.link_documents(frame("doc_id long, text string", rows)).collect()}
    assert got[5000] == got[5001] == 7
    assert all(got[i] == i for i in range(2000))


def test_every_document_is_counted(frame, monkeypatch):
    """The count of a shingle follows from all documents that hold it, whichever these are."""
    monkeypatch.setattr(metric_join, "CHANCE", 0)
    for first in (0, 16):
        rows = [(i, "one two three four" if first <= i < first + 24 else f"a{i} b c d") for i in range(40)]
        bodies = metric_join._bodies(frame("doc_id long, text string", rows), "doc_id", "text")
        table, bits = metric_join._count_table(bodies, 4, 40)
        cell = int(metric_join.shingles(b"one two three four", metric_join.WordHashes())[0] >> np.uint64(56 - bits))
        assert table[cell] == min(24, 40 - first) // metric_join.SAMPLE_SHARE
