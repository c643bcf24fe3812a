import random
import re

import numpy as np
from tenure.llm import decontaminate
from tenure.llm.decontaminate import Automaton


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(items, doc, window):
    hit, found = [False] * len(doc), set()
    for name, item in items:
        size = min(window, len(item))
        for k in range(len(item) - size + 1) if item else ():
            for i in range(len(doc) - size + 1):
                if doc[i : i + size] == item[k : k + size]:
                    found.add(name)
                    hit[i : i + size] = [True] * size
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        letters = ["a", "b", "c"][: rng.randint(1, 3)]
        window = rng.randint(2, 4)
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 8))]) for i in range(rng.randint(0, 4))]
        doc = [rng.choice([*letters, "z"]) for _ in range(rng.randint(0, 25))]
        automaton = Automaton([(n, [w.encode() for w in ws]) for n, ws in items], window)
        hit, found = np.zeros(len(doc), bool), set()
        automaton.scan([w.encode() for w in doc], hit, found)
        assert (hit.tolist(), found) == brute(items, doc, window)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near a river-bank today."),
    (2, "one two three"),
    (3, None),
    (4, ""),
    (10, "ünïcode wörds one two three four five six seven eight nine ten"),
    (None, "no id words here"),
    (2, "one two three"),
]


def corpus(long_text):
    return [
        (1, "before THE QUICK brown; fox jumps over the lazy dog near a tree"),
        (2, "x ONE, two -- three y no id words here"),
        (3, None),
        (4, ""),
        (5, "one two four"),
        (6, long_text + " one two three " + long_text),
        (7, "Ünïcode wörds one two three four five six seven eight nine"),
        (8, "ünïcode wörds one two three four five six seven eight nine"),
        (8, "ünïcode wörds one two three four five six seven eight nine"),
        (None, "one two three"),
    ]


def expected(rows):
    items = [(i, words(t)) for i, t in ITEMS]
    out = []
    for doc_id, text in rows:
        hit, found = brute(items, words(text), 10)
        out.append((doc_id, len(hit), sum(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def reported(df, items):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(df, items).collect()), key=repr)


def test_report_equals_brute_force(frame, long_text):
    rows = corpus(long_text)
    assert reported(frame("doc_id long, text string", rows), frame("item_id long, text string", ITEMS)) == expected(rows)


def test_blocks_of_items_give_the_same(frame, long_text, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 1)
    rows = corpus(long_text)
    df, items = frame("doc_id long, text string", rows), frame("item_id long, text string", ITEMS)
    assert reported(df, items) == expected(rows)
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, items, most_coverage=1.1).collect()}[1] == "before  tree"


def test_spans_and_cuts(frame):
    df = frame("doc_id long, text string, N_HIT string, words int", [(i, t, "x", 7) for i, t in [(1, "é one two three. Rest of the words that stay here"), (2, "one two three end"), (3, "clean text")]])
    items = frame("item_id long, text string", ITEMS)
    report = {r["doc_id"]: r for r in decontaminate.find_contamination(df, items).collect()}
    span = report[1]["spans"][0]
    assert "é one two three. Rest".encode()[span["start"] : span["end"]] == b"one two three" and (span["first_word"], span["last_word"]) == (1, 3)
    assert report[3]["spans"] == []
    kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, items).collect()}
    assert kept == {1: "é . Rest of the words that stay here", 3: "clean text"}
    assert decontaminate.decontaminate(df, items).columns == df.columns


def test_a_cut_cannot_join_a_window(frame):
    df = frame("doc_id long, text string", [(1, "one two one two three three and many other words that stay")])
    kept = decontaminate.decontaminate(df, frame("item_id long, text string", ITEMS), most_coverage=0.9).collect()
    assert "one two" not in kept[0]["text"] and "three" not in kept[0]["text"]


def test_empty_tables(frame):
    df, items = frame("doc_id long, text string", [(1, "a b")]), frame("item_id long, text string", ITEMS)
    assert decontaminate.find_contamination(df.limit(0), items).count() == 0
    assert decontaminate.find_contamination(df, items.limit(0)).collect()[0]["n_hit"] == 0
    assert decontaminate.decontaminate(df, items.limit(0)).collect()[0]["text"] == "a b"


def test_cuts_of_several_blocks_join_no_window(frame, monkeypatch):
    """Items inside each other: every cut brings the ends of another item's window together."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 1)
    items = [(i, " ".join(f"{name}{k}" for k in range(10))) for i, name in enumerate("abcdef")]
    nested = ""
    for _, text in items:
        ws = text.split()
        nested = " ".join([*ws[:5], nested, *ws[5:]])
    other = " ".join(f"clean{i}" for i in range(200))
    rows = [(1, f"{nested} {other}"), (2, other), (3, items[2][1] + " " + other), (4, nested.replace("a9", "z") + " " + other)]
    out = decontaminate.decontaminate(frame("doc_id long, text string", rows), frame("item_id long, text string", items))
    got = {r["doc_id"]: words(r["text"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == words(other)
    assert got[4] == words(rows[3][1])  # an unfinished window inside keeps the outer ones apart
    for doc in got.values():
        assert not any(brute([(i, words(t)) for i, t in items], doc, 10)[0])


def test_automata_are_plain_data(tmp_path):
    """What is broadcast, and the code that reads it, needs no copy of this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    automaton = Automaton([("1", [b"one", b"two"])], 10)
    assert b"tenure" not in automaton.to_bytes()

    class Part:
        value = automaton.to_bytes()

    held = decontaminate._Held([Part])

    def found():
        names = set()
        held.open()[0].scan([b"one", b"two"], np.zeros(2, bool), names)
        return names

    (tmp_path / "f").write_bytes(cloudpickle.dumps(found))
    code = "import sys, pickle; f = pickle.load(open(sys.argv[1], 'rb')); assert f() == {'1'}; assert 'tenure' not in sys.modules"
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "f")], cwd=tmp_path, check=True, env={"PATH": ""})
