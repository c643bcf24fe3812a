import numpy as np
import pytest
from tenure.llm import pu_quality as q
from tenure.llm.common import fold_is_held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, q.fit_on_labels(docs, labels)


def test_held_out_quality(fitted):
    docs, labels, model = fitted
    rows = q.score(docs, model).join(labels, "doc_id").where(fold_is_held_out("doc_id")).select("score", "predicted", "quality").toPandas()
    order = rows.sort_values("score").quality.to_numpy()
    ranks = np.arange(1, len(order) + 1)
    good, bad = order.sum(), len(order) - order.sum()
    assert (ranks[order == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.98
    assert ((rows.predicted == rows.quality).mean()) > 0.96
    assert 0.6 < model.prior < 0.95


def test_scores_depend_on_the_text_only(frame, fitted, long_text):
    model = fitted[2]
    rows = [(1, "same text here.", "en", 1), (2, "same text here.", "xx", 2), (3, None, "en", 3), (4, "", "en", 4), (5, long_text, "en", 5), (None, "x", None, None), (1, "same text here.", "en", 1)]
    out = q.score(frame("doc_id long, text string, lang string, SCORE int", rows), model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    found = out.collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert q.score(frame("doc_id long, text string", []), model).count() == 0


def test_without_positives_or_documents(frame):
    docs = frame("doc_id long, text string", [(1, "a b c"), (2, None)])
    labels = frame("doc_id long, quality int", [])
    assert {r["score"] for r in q.score(docs, q.fit_on_labels(docs, labels)).collect()} == {0.5}
    assert q.fit(docs.limit(0), labels.select("doc_id")).prior == 0.5


def test_sums_equal_a_plain_computation(frame):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(50, len(q.NAMES)))
    positive = rng.random(50) < 0.4
    model = q.Model([sorted(rng.normal(size=3).tolist()) for _ in q.NAMES], np.zeros(0))
    model.weights = rng.normal(size=model.size) / 5
    s = q._sums(frame("v array<double>, positive boolean", [(v.tolist(), bool(p)) for v, p in zip(values, positive, strict=True)]).repartition(3), model)
    bins = model.bins(values)
    g = model.margin(bins)
    dense = np.zeros((50, model.size))
    np.put_along_axis(dense, bins, 1.0, axis=1)
    down = 1 / (1 + np.exp(-g))
    assert np.allclose(s["down_u"], dense.T @ down) and np.allclose(s["down_p"], dense[positive].T @ down[positive])
    assert np.allclose(s["count_p"], dense[positive].sum(axis=0)) and s["n_p"] == positive.sum() and s["n_u"] == 50
    assert np.isclose(s["loss_down_u"], np.log1p(np.exp(g)).sum()) and np.isclose(s["loss_up_p"], np.log1p(np.exp(-g[positive])).sum())


def test_risk_never_rests_below_zero(frame):
    """With far too high a prior the negative part is pushed back instead of being driven down."""
    rng = np.random.default_rng(5)
    rows = [([float(x)] * len(q.NAMES), bool(p)) for x, p in zip(rng.normal(size=200), rng.random(200) < 0.3, strict=True)]
    df = frame("v array<double>, positive boolean", rows)
    model = q.Model([[-1.0, 0.0, 1.0] for _ in q.NAMES], np.zeros(1 + 4 * len(q.NAMES)))
    sample = model.bins(np.array([r[0] for r in rows]))
    q._minimise(df, model, sample, prior=0.98, steps=15)
    assert np.isfinite(model.weights).all()


def test_prior_of_a_known_mixture(frame):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(6000):
        good = rng.random() < 0.6
        rows.append(([float(rng.normal(2 if good else -2))] * len(q.NAMES), bool(good and rng.random() < 0.5)))
    df = frame("v array<double>, positive boolean", rows)
    edges = [np.quantile([r[0][0] for r in rows], np.arange(1, 12) / 12).tolist()] + [[] for _ in q.NAMES[1:]]
    model = q.Model(edges, np.zeros(1 + sum(len(e) + 1 for e in edges)))
    sample = model.bins(np.array([r[0] for r in rows[:2000]]))
    q._minimise(df, model, sample, prior=0.5, steps=6)
    assert abs(q._prior(df, model) - 0.6) < 0.08
