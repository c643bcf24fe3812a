import hashlib
import random
import re

import pytest
from tenure.llm import content_sort


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def marked(df):
    return sorted((tuple(r) for r in content_sort.mark_copies(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.fixture
def rows(long_text):
    rng = random.Random(5)
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a b", "A b", "a b ", "x" * 40 + "1", "x" * 40 + "2", "x" * 40 + "2", long_text, long_text + " end"]
    out = [(i, rng.choice(texts)) for i in range(200)]
    return out + out[:5] + [(None, "a b"), (None, "only here"), (None, "only here")]


def test_equals_brute_force(frame, rows):
    assert marked(frame("doc_id long, text string", rows)) == brute(rows)


def test_frequent_texts_are_dealt_over_runs(frame, rows, monkeypatch):
    monkeypatch.setattr(content_sort, "HITS", 1)
    monkeypatch.setattr(content_sort, "ROWS_PER_RUN", 4)
    assert marked(frame("doc_id long, text string", rows)) == brute(rows)


def test_empty_table_and_clashing_columns(frame):
    assert content_sort.mark_copies(frame("doc_id long, text string", [])).count() == 0
    df = frame("doc_id long, text string, Keep_ID string, least string, `a.b` int, n int, salt int", [(2, "x", "k", "l", 1, 2, 3), (1, "x", "k", "l", 1, 2, 3)])
    out = content_sort.mark_copies(df)
    assert out.columns == ["doc_id", "text", "least", "a.b", "n", "salt", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["a.b"]) for r in out.collect()) == [(1, 1, True, 1), (2, 1, False, 1)]


def test_deduplicate_keeps_one_row_for_each_text(frame, rows):
    kept = content_sort.deduplicate(frame("doc_id long, text string", rows))
    assert kept.columns == ["doc_id", "text"]
    assert kept.count() == len({r[4] for r in brute(rows)})


def test_plan_has_no_python_and_sorts_contents(frame, rows):
    plan = content_sort.mark_copies(frame("doc_id long, text string", rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
