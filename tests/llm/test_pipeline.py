import math
import random

import corpus_pipeline
import pytest
from tenure.llm import pu_quality

from test_decontaminate import brute as brute_hits
from test_decontaminate import words
from test_line_dedup import brute as brute_lines
from test_metric_join import brute as brute_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(frame, table_dir):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ar", "el", "in", "os", "un")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    shared = prose(14)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(3)]
    texts = []
    for i in range(160):
        text = "\n".join(prose(rng.randint(8, 40)) for _ in range(rng.randint(1, 4)))
        if i % 7 == 0:
            text += "\n" + shared
        if i % 11 == 0:
            text += " " + items[i % 3][1]
        if i % 5 == 0:
            text = "!!!! ".join(text.upper().split()[:40])
        texts.append(text)
    texts += [None, "", items[0][1]]
    long = prose(200)
    texts += [long, long.replace(" bar ", " bel ", 1), long + " tail"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", len(texts[1]))]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 160) if i % 3]
    return table_dir(
        documents=frame(SCHEMA, rows), labels=frame("doc_id long, quality int, toxic int", labels), benchmark=frame("item_id long, text string", items)
    )


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_each_stage_equals_brute_force_on_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing",
    ]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out_path = str(tmp_path / f"out{k}")
        step(spark, docs, folder).write.parquet(out_path)
        out, before = spark.read.parquet(out_path), rows_of(docs)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "quality_classifier":
            model = pu_quality.fit_on_labels(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            want = [r for r in before if model.margin(model.bins(pu_quality.measured([None if r[1] is None else r[1].encode()])))[0] >= math.log(0.3 / 0.7)]
            assert rows_of(out) == want and 0 < len(want) < len(before)
        elif name == "line_dedup":
            assert rows_of(out) == sorted(((i, t) for i, t, *_ in brute_lines(before)), key=repr)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "ngram_jaccard_join":
            stays = {i for i, _, c in brute_links(before) if i == c}
            assert rows_of(out) == [r for r in before if r[0] in stays] and len(stays) < len(before)
        elif name == "benchmark_decontamination":
            hits = {i: brute_hits(items, words(t), 10)[0] for i, t in before}
            kept = dict(rows_of(out))
            assert set(kept) == {i for i, h in hits.items() if not h or sum(h) < 0.5 * len(h)}
            assert any(map(any, hits.values()))
            for i, t in before:
                if i in kept:
                    assert words(kept[i]) == [w for w, h in zip(words(t), hits[i], strict=True) if not h]
        else:
            found = {}
            for r in sorted(out.collect(), key=lambda r: (r["doc_id"], r["piece"])):
                found[r["doc_id"]] = found.get(r["doc_id"], "") + (r["text"] or "")
            ids = [i for i, _ in before]
            assert found == {i: (t or "") * ids.count(i) for i, t in before}
        docs = out


def test_near_copies_of_five_words_and_80_percent_go(spark, frame):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(96)]

    def edited(*places):
        return [f"e{p}" if p in places else w for p, w in enumerate(base)]

    # Two edits: 82 of 102 shingles of 5 words shared (0.80), 85 of 101 of 4 words (0.84). Three edits: 77 of 107 (0.72).
    texts = [base, edited(30, 60), edited(20, 50, 80), base, [f"v{rng.random()}" for _ in range(96)]]
    docs = frame(SCHEMA, [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate(texts)])

    def similarity(a, b, size):
        x, y = ({tuple(t[i : i + size]) for i in range(len(t) - size + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    assert similarity(base, texts[1], 5) >= 0.8 and similarity(base, texts[1], 4) < 0.85 and similarity(base, texts[2], 5) < 0.8
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and [i for i, _ in rows_of(out)] == [0, 2, 4]


def test_run_returns_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "piece", "bin_id", "bin_offset", "bin_capacity"} <= set(out.columns)
    assert out.count() > 50


def test_an_empty_table_passes_all_stages(spark, frame, table_dir):
    folder = table_dir(documents=frame(SCHEMA, []), labels=frame("doc_id long, quality int, toxic int", []), benchmark=frame("item_id long, text string", []))
    assert corpus_pipeline.run(spark, folder).count() == 0
