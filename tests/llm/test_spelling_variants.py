import random
import re
import zlib
from collections import Counter

import pytest
from tenure.llm import spelling_variants
from tenure.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """One edit apart, by trying all deletions and replacements."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, drop_every=31):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, out = {}, []
    close = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if near(w, v)] for w in n}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeéßÿ×"
    bases = ["".join(rng.choices(letters, k=rng.randint(6, 12))) for _ in range(60)] + ["aaaaaaaa", "abababab", "Straßenbahn"]
    words = []
    for base in bases:
        words += [base] * rng.choice([2, 30, 300])
        for _ in range(6):
            w, k, i = base, rng.randrange(3), rng.randrange(len(base))
            w = w[:i] + ("" if k == 0 else rng.choice(letters)) + w[i + (k != 1) :]
            words += [w] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    return [(i, " ".join(words[i::50])) for i in range(50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(frame, seed):
    docs = corpus(seed)
    assert result(spelling_variants.group_variants(frame(SCHEMA, docs))) == brute(docs)


def test_every_pair_meets_once(frame):
    """Repeated letters, edits in the middle, at the ends and of words of both parities."""
    rng = random.Random(6)
    words = {"".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(400)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa"}
    found = spelling_variants._pairs(frame("word string, n long", [(w, 5) for w in sorted(words)])).collect()
    assert sorted((r[0], r[2]) for r in found) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_chain_of_forms(frame):
    text = " ".join(["abcdefgh"] * 1000 + ["abcdefghi"] * 100 + ["abcdefghij"] * 10 + ["abcdefghijk"] * 2 + ["zbcdefgh"] * 100)
    docs = [(1, text)]
    got = {r["word"]: r for r in spelling_variants.group_variants(frame(SCHEMA, docs), drop_every=0).collect()}
    assert got["abcdefghij"]["root"] == "abcdefgh" and got["abcdefghij"]["form"] == "abcdefghi"
    assert got["abcdefghijk"]["form"] is None
    assert result(spelling_variants.group_variants(frame(SCHEMA, docs), drop_every=0)) == brute(docs, 0)


def test_defined_edges(frame, long_text):
    docs = [(1, None), (2, ""), (None, "Elephant elephants ELEPHANT"), (3, "elephant elephant"), (3, "elephant elephant"), (4, "Änderung änderung aenderung日本Elephant")]
    docs += [(5, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], long_text))]
    assert result(spelling_variants.group_variants(frame(SCHEMA, docs))) == brute(docs)
    assert result(spelling_variants.group_variants(frame(SCHEMA, []))) == []
    named = frame("doc_id long, text string, word string, n int, sig long", [(i, "elephant elephants", "w", 1, 2) for i in range(9)])
    assert result(spelling_variants.group_variants(named)) == brute([(i, "elephant elephants") for i in range(9)])


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op13_spelling_variants"](spark, sf)) == brute(docs)
