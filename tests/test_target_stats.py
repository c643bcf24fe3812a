import pytest
from pyspark.sql import functions as F

from tenure.models.target_stats import fit_forest_on_rates, fit_target_stats, predict_on_rates
from tenure.operators.ranking import auc
from tenure.operators.sampling import fold_number


def rate(rows, level, fold, prior_rows=10.0):
    """Smoothed rate of a level over the rows outside of a fold."""
    others = [(v, y) for _, v, y, f in rows if f != fold]
    prior = sum(y for _, y in others) / len(others)
    own = [y for v, y in others if v == level]
    return (sum(own) + prior_rows * prior) / (len(own) + prior_rows)


def test_rates_leave_out_the_own_fold(spark):
    data = [(i, [None, "a", "b", "c", ""][i * i % 5], int(i % 7 < 3)) for i in range(200)] + [(500, "a", None), (501, "once", 1)]
    df = spark.createDataFrame(data, "id long, v string, y int")
    rows = [tuple(r) for r in df.where("y is not null").select("id", "v", "y", fold_number(F.col("id"), 5, 1)).collect()]
    stats = fit_target_stats(df, ["v"], "y", "id")
    got = {r["id"]: r["v__rate"] for r in stats.encode(df.where("y is not null"), training=True).collect()}
    for i, v, _, fold in rows:
        assert got[i] == pytest.approx(rate(rows, v, fold))
    later = spark.createDataFrame([(1, "a"), (2, None), (3, "new")], "id long, v string")
    found = {r["id"]: r["v__rate"] for r in stats.encode(later).collect()}
    assert [found[i] for i in (1, 2, 3)] == pytest.approx([rate(rows, v, -1) for v in ("a", None, "new")])


def test_a_column_of_very_many_levels(spark):
    """100,000 levels, a few hundred of which decide the label; ids repeat within levels."""
    level = F.when(F.col("id") % 3 == 0, F.col("id") % 300).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)))
    rows = spark.range(150_000).select("id", F.concat(F.lit("level "), level.cast("string")).alias("who"), (F.col("id") % 11).cast("double").alias("x"))
    hot = (F.col("id") % 3 == 0) & (F.col("id") % 300 < 150)
    rows = rows.withColumn("y", (hot | (F.pmod(F.hash("id"), F.lit(50)) == 0)).cast("int"))
    train, test = rows.where("id % 7 <> 0"), rows.where("id % 7 = 0")
    stats, model = fit_forest_on_rates(train, ["who", "x"], "y", "id", ["who"], trees=5, depth=4)
    scored = predict_on_rates(stats, model, test)
    assert scored.columns == [*test.columns, "pred"] and scored.where("pred is null").isEmpty()
    assert auc(scored, "pred", "y").first()[0] > 0.85
    assert not any(hasattr(s, "labelsArray") for s in model.stages)
