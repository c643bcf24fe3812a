import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tenure.models import classifiers, logit, scoring, validation
from tenure.models.design import spread
from tenure.operators import ranking, reshape, sampling
from tenure.plans.dataset import clean_scoring_dataset, scoring_dataset
from tenure.session import stage
from verification import binding as b

N = 6000


@pytest.fixture(scope="module")
def planted(spark):
    """Labels drawn from known coefficients over two numbers, a flag and a category."""
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=N), rng.normal(size=N)
    flag, plan = rng.random(N) < 0.4, rng.choice(["awesome", "business", "small"], N)
    eta = -1.0 + 1.5 * x - 0.5 * z + 0.8 * flag + np.where(plan == "business", 0.7, 0.0)
    y = rng.random(N) < 1 / (1 + np.exp(-eta))
    data = [(i, float(x[i]), float(z[i]), bool(flag[i]), str(plan[i]), bool(y[i])) for i in range(N)]
    df = spark.createDataFrame(data, "id long, x double, z double, flag boolean, plan string, y boolean")
    # Unrelated missing column: it must not remove rows.
    return df.withColumn("canceled_at", F.lit(None).cast("date")).cache()


def newton(matrix, y):
    beta = np.zeros(matrix.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-matrix @ beta))
        information = matrix.T @ (matrix * (p * (1 - p))[:, None])
        beta += np.linalg.solve(information, matrix.T @ (y - p))
    p = 1 / (1 + np.exp(-matrix @ beta))
    deviance = -2 * np.sum(np.where(y, np.log(p), np.log(1 - p)))
    return beta, np.sqrt(np.diag(np.linalg.inv(information))), deviance


def test_logit_equals_newton_iterations(planted):
    features = ["x", "z", "flag", "plan"]
    fitted = logit.fit_logit(planted, features, "y", scaled=["z"])
    pdf = planted.toPandas()
    scaled = (pdf.z - pdf.z.mean()) / pdf.z.std(ddof=1)
    matrix = np.column_stack(
        [pdf.x, scaled, pdf.flag, pdf["plan"] == "business", pdf["plan"] == "small", np.ones(N)]
    ).astype(float)
    beta, errors, deviance = newton(matrix, pdf.y.to_numpy())
    table = {r["term"]: r for r in fitted.coefficients().collect()}
    terms = ["x", "scale(z)", "flag", "plan_business", "plan_small", "(Intercept)"]
    assert list(table) == terms
    for term, estimate, error in zip(terms, beta, errors, strict=True):
        assert table[term]["estimate"] == pytest.approx(estimate, abs=1e-5)
        assert table[term]["std_error"] == pytest.approx(error, rel=1e-4)
        assert table[term]["z_value"] == pytest.approx(estimate / error, rel=1e-3, abs=1e-3)
    stats = fitted.fit_statistics().first()
    assert stats["residual_deviance"] == pytest.approx(deviance, rel=1e-6)
    assert stats["aic"] == pytest.approx(deviance + 2 * 6, rel=1e-6)
    assert (stats["null_df"], stats["residual_df"]) == (N - 1, N - 6)


def test_scoring_keeps_rows_with_unseen_levels_and_missing_inputs(spark, planted, tmp_path):
    train = planted.where("plan <> 'small'")
    model = logit.fit_logit(train, ["x", "plan"], "y").pipeline
    model.write().save(str(tmp_path / "m"))
    loaded = scoring.get_model(str(tmp_path / "m"), lambda: pytest.fail("must not refit"))
    new = spark.createDataFrame(
        [(1, 0.5, "awesome"), (2, 0.5, "small"), (3, 0.5, None), (4, None, "awesome")],
        "subscription_id long, x double, plan string",
    )
    out = {r["subscription_id"]: r["pred"] for r in logit.predict_logit(loaded, new).collect()}
    assert out[1] == out[2] == out[3] and 0 < out[1] < 1 and out[4] is None
    rows = {r["subscription_id"]: r for r in scoring.score(loaded, new, "2024-02-01 06:00:00").collect()}
    assert rows[1]["churn_probability"] == round(out[1], 2)
    assert rows[1]["id"] == f"1{round(out[1], 2)}2024-02-01 06:00:00logistic_regression0.1"
    assert len(rows) == 4 and rows[4]["id"].startswith("4NA")


def test_dependent_features_have_no_coefficient(planted):
    """A copy, a sum of earlier columns and a constant are left out; the others keep their tests."""
    rows = planted.withColumns({"copy": 3 * F.col("x") - 1, "sum": F.col("x") + 2 * F.col("z"), "one": F.lit(7.0)})
    plain = {r["term"]: r for r in logit.fit_logit(planted, ["x", "z"], "y").coefficients().collect()}
    fitted = logit.fit_logit(rows, ["x", "copy", "z", "one", "sum"], "y")
    found = {r["term"]: r for r in fitted.coefficients().collect()}
    assert list(found) == ["x", "copy", "z", "one", "sum", "(Intercept)"]
    for term in ("copy", "one", "sum"):
        assert found[term]["estimate"] is found[term]["std_error"] is found[term]["p_value"] is None
    for term in ("x", "z", "(Intercept)"):
        assert found[term]["estimate"] == pytest.approx(plain[term]["estimate"]) and found[term]["std_error"] == pytest.approx(plain[term]["std_error"])
    scores = logit.predict_logit(fitted.pipeline, rows).where("pred is not null")
    assert scores.count() == rows.count()


def test_independent_terms_of_a_correlation_matrix():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 500))
    x = np.stack([a, b, a + b, np.ones(500), a * b, 2 * b - a + 5], axis=1)
    with np.errstate(invalid="ignore"):
        assert logit.independent_terms(np.corrcoef(x, rowvar=False)) == [0, 1, 4]
    assert logit.independent_terms(np.array([[np.nan]])) == []


@pytest.mark.parametrize("kind", ["forest", "mlp", "svc"])
def test_classifiers_rank_planted_labels(planted, kind):
    train, test = sampling.hash_split(planted, "id", 0.8, 3)
    features = ["x", "z", "flag", "plan"]
    model = {
        "forest": lambda: classifiers.fit_forest(train, features, "y", trees=20, depth=5),
        "mlp": lambda: classifiers.fit_mlp(train, features, "y", hidden=[8], iterations=40),
        "svc": lambda: classifiers.fit_svc(train, features, "y", iterations=10),
    }[kind]()
    scored = classifiers.predict_classifier(model, test)
    assert scored.count() == test.count()
    assert ranking.auc(scored, "pred", "y").first()["auc"] > 0.75


def test_importance_finds_the_strong_feature(planted):
    features = ["x", "z", "flag", "plan"]
    model = classifiers.fit_forest(planted, features, "y", trees=20, depth=5)
    impurity = {r["feature"]: r["importance"] for r in classifiers.importance(model, features).collect()}
    assert max(impurity, key=impurity.get) == "x" and sum(impurity.values()) == pytest.approx(1.0)
    losses = classifiers.permutation_importance(model, planted, features, "y", "id")
    by_name = {r["feature"]: r for r in losses.collect()}
    assert set(by_name) == set(features)
    assert by_name["x"]["auc_loss"] == max(r["auc_loss"] for r in by_name.values()) > 0.1
    assert by_name["x"]["accuracy_loss"] > 0.03


def test_exchange_moves_every_value_to_another_row(planted):
    out = classifiers.exchanged_rows(planted.select("id", "x", "plan"), ["x", "plan"], "id", seed=2)
    rows = out.collect()
    assert len(rows) == N and len({r["id"] for r in rows}) == N
    assert sorted(r["x"] for r in rows) == sorted(r["other"]["x"] for r in rows)
    assert sum(r["x"] == r["other"]["x"] for r in rows) < 5
    alone = classifiers.exchanged_rows(planted.where("id = 3").select("id", "x"), ["x"], "id").first()
    assert alone["other"]["x"] == alone["x"]


def test_hashed_levels_keep_the_model_small(planted):
    many = planted.withColumn("code", F.concat(F.lit("c"), F.col("id")))
    model = classifiers.fit_forest(many, ["x", "z", "code"], "y", trees=10, depth=4, hashed=["code"])
    assert model.stages[-1].getOrDefault("maxBins") == 32
    assert ranking.auc(classifiers.predict_classifier(model, many), "pred", "y").first()["auc"] > 0.7


def test_rows_of_a_fit_are_spread_over_the_cores(spark, planted):
    few = stage(planted.coalesce(1))
    rows, cores = spread(few), spark.sparkContext.defaultParallelism
    sizes = [n for _, n in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert few.rdd.getNumPartitions() == 1 and len(sizes) == cores and max(sizes) < 1.2 * N / cores
    assert rows.exceptAll(few).isEmpty() and rows.count() == N
    assert spread(rows) is rows


def test_rows_of_a_network_are_spread(spark, planted, monkeypatch):
    dealt, run = [], classifiers.spread
    monkeypatch.setattr(classifiers, "spread", lambda rows: dealt.append(run(rows)) or dealt[-1])
    classifiers.fit_mlp(planted.coalesce(1), ["x", "z"], "y", hidden=(2,), iterations=1)
    assert dealt[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_places_in_the_trees_are_held_up_to_a_bound(planted, monkeypatch):
    fitted = []
    for held in (N * 5, N * 5 - 1):
        monkeypatch.setattr(classifiers, "HELD_PLACES", held)
        fitted.append(classifiers.fit_forest(planted, ["x", "z", "flag"], "y", trees=5, depth=4))
    assert [m.stages[-1].getCacheNodeIds() for m in fitted] == [True, False]
    # On the same partitions the trees are the same.
    prepared = stage(PipelineModel(fitted[0].stages[:-1]).transform(planted.withColumn("y", F.col("y").cast("double"))).select("features", "y"))
    trees = [classifiers._forest("y", 5, 4, 1, 0, rows).fit(prepared).toDebugString for rows in (N - 1, N)]
    assert trees[0].split("\n", 1)[1] == trees[1].split("\n", 1)[1]


def test_folds_wait_for_each_other_when_their_rows_are_many(planted, monkeypatch):
    asked, run = [], classifiers.together

    def noted(spark, jobs, parallel):
        asked.append(parallel)
        return run(spark, jobs, parallel)

    monkeypatch.setattr(classifiers, "together", noted)
    sizes = []
    for held in (N * 100, N * 5, 1):  # four fifths of the rows, three trees
        monkeypatch.setattr(classifiers, "HELD_PLACES", held)
        folds = classifiers.cross_validate(planted, ["x", "z"], "y", "id", trees=3, depth=2)
        sizes.append(sorted(tuple(r) for r in folds.select("fold", "n", "positives").collect()))
    assert asked == [5, 2, 1]
    assert sizes[0] == sizes[1] == sizes[2] and sum(n for _, n, _ in sizes[0]) == N


def test_cross_validated_auc(planted):
    mean, spread = classifiers.cross_val_auc(planted, ["x", "z"], "y", "id", k=3, trees=10, depth=4)
    assert 0.75 < mean < 0.95 and 0 <= spread < 0.1


def test_random_baseline_is_worse_than_the_model(planted):
    flagged = sampling.random_baseline(planted, planted, "id", "y", 2)
    rate, base = (r := flagged.agg(F.avg(F.col("flagged").cast("int")), F.avg(F.col("y").cast("int"))).first())[0], r[1]
    assert abs(rate - base) < 0.03
    scored = flagged.select("y", F.col("flagged").cast("double").alias("s"))
    assert abs(ranking.auc(scored, "s", "y").first()["auc"] - 0.5) < 0.03


def test_validation_file_gets_the_training_layout(spark):
    schema = (
        "subscription_id long, plan_id string, twofactor_type string, trial_start_at string, "
        "has_verified_email string, number_of_profiles int, churned_in_next_two_months string, user_id string"
    )
    train = spark.createDataFrame(
        [(1, "p", "sms", "2017", "t", None, "t", "u"), (2, "q", None, None, "f", 3, "f", "u")], schema
    )
    later = spark.createDataFrame([(3, "r", "sms", None, None, 1, "f", "u")], schema)
    found = reshape.level_lists(reshape.find_levels(train, ["plan_id", "twofactor_type"]))
    prepared, aligned = validation.train_and_validation(train, later, found)
    assert prepared.columns == aligned.columns
    assert {"plan_id_p", "plan_id_q", "twofactor_type_sms", "trialed"} <= set(prepared.columns)
    assert not {"plan_id", "user_id", "trial_start_at"} & set(prepared.columns)
    row = aligned.first()
    assert (row["plan_id_p"], row["plan_id_q"], row["twofactor_type_sms"]) == (0, 0, 1)
    assert row["has_verified_email"] is False and row["trialed"] is False
    first = prepared.where("subscription_id = 1").first()
    assert first["number_of_profiles"] == 0 and first["churned_in_next_two_months"] is True


def test_validate_uses_the_base_rate_of_each_part(spark):
    data = [("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.9, 1), ("b", 0.8, 0), ("b", 0.2, 0), ("b", 0.1, 0)]
    df = spark.createDataFrame(data, "part string, p double, y int")
    out = {r["part"]: r for r in validation.validate(df, "p", "y", 0.5, ["part"]).collect()}
    assert out["a"]["enrichment"] == 2.0 and out["b"]["enrichment"] == 2.0
    assert out["b"]["precision"] == 0.5 and out["b"]["auc"] == 1.0


def test_scoring_run_is_repeatable(spark, tmp_path):
    src = b.sources(spark, "/root/testdata/sf0.01")
    where = [str(tmp_path / n) for n in ("f1", "p1", "f2", "p2", "model")]

    def run(current, target, **model):
        return scoring.run_scoring(
            spark, src, b.T, "2024-02-01 06:00:00", (current[0], target[0]), (current[1], target[1]),
            usage_t=b.T_USAGE, **model,
        )

    first = run((None, None), where[:2], save_model_to=where[4])
    second = run(where[:2], where[2:4], model_path=where[4])
    expected = clean_scoring_dataset(scoring_dataset(src, b.T, b.T_USAGE), b.T).count()
    assert first.count() == second.count() == expected
    assert first.exceptAll(second).isEmpty()
    assert spark.read.parquet(where[2]).count() == expected
    assert isinstance(PipelineModel.load(where[4]), PipelineModel)


def test_scoring_run_takes_a_batch_as_it_was_built(spark, tmp_path):
    src = b.sources(spark, "/root/testdata/sf0.01")
    batch = scoring.scoring_batch(src, b.T, b.T_USAGE)
    where = [str(tmp_path / n) for n in ("f", "p")]
    scored = scoring.run_scoring(spark, {}, b.T, "2024-02-01 06:00:00", (None, where[0]), (None, where[1]), batch=batch)
    assert scored.count() == batch.count() == spark.read.parquet(where[0]).count()
