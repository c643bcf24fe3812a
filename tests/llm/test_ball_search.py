import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tenure.llm import ball_search
from tenure.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    """All documents of every item, scored by the definition in whole numbers."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            score = 0
            for t in terms(text):
                if bag[t]:
                    m = 100 - 25 + (25 * sum(bag.values()) * n) // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, size=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "Straße", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(7 * i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200])))) for i in range(size)]
    docs += [(7 * i + 1, docs[i][1]) for i in range(0, 60, 2)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 40])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("tree, leaf, block", [(4096, 64, 200_000), (50, 4, 60)])
def test_equals_all_scores(frame, monkeypatch, tree, leaf, block):
    monkeypatch.setattr(ball_search, "TREE_DOCS", tree)
    monkeypatch.setattr(ball_search, "LEAF_DOCS", leaf)
    monkeypatch.setattr(ball_search, "BLOCK_WORDS", block)
    docs, items = corpus(tree)
    assert result(ball_search.search(frame(DOCS, docs), frame(ITEMS, items))) == brute(docs, items)


def test_defined_edges(frame, long_text):
    docs = [(1, None), (2, ""), (3, "!!!"), (None, "apple pie"), (4, "Apple pie"), (4, "Apple pie"), (5, "apple"), (6, long_text + " apple"), (9, "other words")]
    items = [(1, "apple"), (1, "apple"), (2, None), (3, "..."), (4, "unknown"), (None, "pie pie apple")]
    assert result(ball_search.search(frame(DOCS, docs), frame(ITEMS, items))) == brute(docs, items)
    assert result(ball_search.search(frame(DOCS, docs), frame(ITEMS, []))) == []
    assert result(ball_search.search(frame(DOCS, []), frame(ITEMS, items))) == []
    assert result(ball_search.search(frame(DOCS, [(1, None)]), frame(ITEMS, items))) == []


def test_clashing_names_and_text_ids(frame):
    docs = frame("doc_id long, text string, rank int, score string, q int, item string", [(i, f"a b{i % 3}", 1, "s", 2, "t") for i in range(30)])
    items = frame("item_id string, text string, id int, block int", [("x", "a b1", 1, 1), ("y", "b2", 1, 1)])
    want = brute([(i, f"a b{i % 3}") for i in range(30)], [("x", "a b1"), ("y", "b2")], top=4)
    assert result(ball_search.search(docs, items, top=4)) == want


def test_bounds_hold_and_prune(monkeypatch):
    """No document of a node scores above its bound, and separated groups are not scored."""
    monkeypatch.setattr(ball_search, "LEAF_DOCS", 8)
    rng = np.random.default_rng(4)
    groups = [np.sort(rng.choice(200, 20, replace=False)) for _ in range(10)]
    rows = [groups[i % 10] for i in range(500)]
    impacts = rng.integers(400_000, 500_000, (500, 20))
    weights = rng.integers(0, 9000, 200)
    items = ball_search.Items([{int(t): 1 + int(t) % 3 for t in g} for g in groups], weights)
    tree = ball_search.Tree(np.arange(0, 10_000, 20), np.concatenate(rows), impacts.reshape(-1), np.sqrt(weights), items)
    leaves = sum(s is not None for s in tree.slices)
    for i, q in enumerate(items.asked):
        weight = np.zeros(200, np.int64)
        weight[items.terms[q]] = items.exact[q]
        exact = np.array([(impacts[d] * weight[rows[d]]).sum() for d in range(500)])
        for node, part in enumerate(tree.slices):
            if part:
                assert exact[tree.order[part[0] : part[1]]].max() <= tree.bounds[node][i]
        best = []
        scored = tree.search(i, weight, np.arange(500), best, 0, 20)
        assert sorted(best, reverse=True) == sorted(((int(s), -d) for d, s in enumerate(exact) if s > 0), reverse=True)[:20]
        assert scored < leaves / 2


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = QUERIES["op12_ball_search"](spark, sf).select("item_id", "rank", "doc_id", "score")
    assert result(got) == brute(docs, items)
