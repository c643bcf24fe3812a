import random

import numpy as np
from tenure.llm import line_dedup, seen_twice


def key_of(line):
    low = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in low)


def brute(rows):
    """Texts by (id, text): smallest document of every key of at least 10 code points."""
    big = 2**63 - 1
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders.setdefault(key_of(line), set()).add(big if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = big if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < 2 or min(holders[key_of(x)]) == own]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in line_dedup.drop_repeated_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def corpus(long_text):
    rng = random.Random(2)
    lines = ["", "short", "exactly te", "EXACTLY TE", " exactly te\t", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "nine char", " nine char", "a license line of all", "A License line of all \r", long_text]
    rows = [(i, "\n".join(rng.choice(lines + [f"only in {i} {j}"]) for j in range(rng.randint(1, 6)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (None, "a license line of all"), (None, "a line of no id"), rows[3], rows[4]]


def test_equals_brute_force(frame, long_text):
    rows = corpus(long_text)
    assert result(frame("doc_id long, text string", rows)) == brute(rows)


def test_full_filters_change_nothing(frame, long_text, monkeypatch):
    """With every bit set all keys are suspects; the exact step decides."""
    monkeypatch.setattr(seen_twice, "maybe_twice", lambda hashes, filter_, bits: np.ones(len(hashes), bool))
    rows = corpus(long_text)
    assert result(frame("doc_id long, text string", rows)) == brute(rows)


def test_repeats_always_pass_the_filter():
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    parts = []
    for chunk in (np.concatenate((once, twice)), twice):
        sink = seen_twice.Collector(20, most=2000)
        parts += [*sink.add(chunk[:3000]), *sink.add(chunk[3000:]), *sink.flush()]
    found = {}
    for batch in seen_twice._merge(iter(sorted(parts, key=lambda b: b.column(0)[0].as_py())), True):
        found[batch.column(0)[0].as_py()] = batch.column(1)[0].as_py()
    filter_ = np.frombuffer(found[0], np.uint8)
    assert seen_twice.maybe_twice(twice, filter_, 20).all()
    assert seen_twice.maybe_twice(once, filter_, 20).mean() < 0.05


def test_empty_table_and_clashing_columns(frame):
    assert line_dedup.drop_repeated_lines(frame("doc_id long, text string", [])).count() == 0
    df = frame("doc_id long, N_lines string, text string, id int, line_key int", [(1, "x", "same line here", 7, 8), (2, "y", "same line here", 7, 8)])
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "id", "line_key", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"], r["n_dropped"], r["id"]) for r in out.collect()) == [(1, "same line here", 0, 7), (2, "", 1, 7)]


def test_text_column_in_another_case(frame):
    df = frame("Doc_ID long, Text string, lang string", [(1, "a line of text\nown words here", "x"), (2, "A line of text ", "y")])
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == ["Doc_ID", "Text", "lang", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "a line of text\nown words here", "x", 2, 0), (2, "", "y", 1, 1)]
