import random
from collections import Counter

from pyspark.sql import functions as F
from tenure.llm import packing


def sequential_best_fit(lengths, capacity):
    """Bins of plain best-fit decreasing with one capacity: used tokens of each."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(capacity - r for r in rooms)


def checked(rows, capacities):
    """Pieces of a bin lie one after the other, inside the smallest capacity that holds them."""
    bins = {}
    for r in rows:
        if r["length"]:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["bin_capacity"] for r in pieces} == {min(c for c in capacities if c >= at)}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_one_capacity_equals_sequential_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 15))}
        plan = packing.plan_bins(counts, [40])
        used = sorted(u for _, n, u, _ in plan.bins for _ in range(n))
        assert used == sequential_best_fit([n for n, k in counts.items() for _ in range(k)], 40)


def test_every_piece_is_placed_once():
    rng = random.Random(2)
    counts = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(40)}
    plan = packing.plan_bins(counts, [16, 64, 100])
    placed = Counter()
    for length, first, n, *_ in plan.placed:
        assert first == placed[length]
        placed[length] += n
    assert placed == counts


def test_several_capacities_cost_less_than_the_largest_alone(frame):
    rng = random.Random(3)
    rows = [(i, rng.choice([3, 10, 60, 90, 120, 450])) for i in range(400)]
    df = frame("doc_id long, size long", rows)
    cost = {}

    def price(capacity):
        return capacity * (1 + capacity / 256) + 16

    for capacities in ([2048], [128, 512, 2048]):
        out = packing.pack(df, length=F.col("size"), capacities=capacities, cost=price).collect()
        bins = checked(out, capacities)
        assert sum(r["length"] for r in out) == sum(n for _, n in rows)
        cost[len(capacities)] = sum(price(b[0]["bin_capacity"]) for b in bins.values())
    assert cost[3] < cost[1]


def test_texts_are_cut_and_come_back_whole(frame, long_text, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_RUN", 7)
    texts = [None, "", " \n ", "one", "a b  c\n", long_text, "  lead " + "w " * 63, "v " * 64, "ü " * 65]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "x"), (None, "no id", "x")]
    rows += [(100 + i, "same length of words here", "x") for i in range(60)]
    df = frame("doc_id long, text string, PIECE string", rows)
    out = packing.pack(df, capacities=[16, 64])
    assert out.columns == ["doc_id", "text", *packing.PRODUCED]
    found = out.collect()
    checked(found, [16, 64])
    for i, text in enumerate(texts):
        pieces = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["piece"])
        if i != 3:
            assert "".join(p["text"] or "" for p in pieces) == (text or "")
        words = len((text or "").split())
        assert sum(p["length"] for p in pieces) == (words + (words > 0)) * (2 if i == 3 else 1)
        assert all(p["start"] == 64 * p["piece"] and p["length"] <= 64 for p in pieces)
    assert sum(r["doc_id"] is None for r in found) == 1


def test_words_in_counts_like_the_cut(frame):
    rows = [(1, "a b\tc\x0b d"), (2, None), (3, "  "), (4, "x y z")]
    out = {r["doc_id"]: r["n"] for r in frame("doc_id long, text string", rows).select("doc_id", packing.words_in(F.col("text")).alias("n")).collect()}
    assert out == {1: 5, 2: 0, 3: 0, 4: 3}


def test_empty_table(frame):
    assert packing.pack(frame("doc_id long, text string", [])).count() == 0


def test_ties_and_columns_with_produced_names(frame, monkeypatch):
    """Rows that repeat an id and a length are placed apart; columns named like produced ones are replaced."""
    monkeypatch.setattr(packing, "PIECES_PER_RUN", 7)
    rows = [(1, 5, "a", 1.0)] * 40 + [(None, 5, "b", 2.0)] * 10 + [(2, 0, "c", 3.0), (2, None, "d", 4.0)]
    df = frame("doc_id long, size long, Bin_Id string, LENGTH double", rows)
    out = packing.pack(df, length=F.col("size"), capacities=[16, 64])
    assert out.columns == ["doc_id", "size", *packing.PRODUCED]
    found = out.collect()
    checked(found, [16, 64])
    assert len(found) == len(rows)
    assert len({(r["bin_id"], r["bin_offset"]) for r in found if r["length"]}) == 50
    assert [r["bin_id"] for r in found if not r["length"]] == [None, None]
