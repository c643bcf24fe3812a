"""Counts, shares, distributions and other descriptive aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators.running import renamed, running_totals, same_group


def share(
    df: DataFrame,
    keys: Sequence[str],
    within: Sequence[str] = (),
    distinct: str | None = None,
) -> DataFrame:
    """Rows per key combination and their share of all rows, or of the ``within`` group.

    ``distinct`` counts distinct values of that column instead of rows.
    """
    count = F.count_distinct(distinct) if distinct else F.count("*")
    tally = df.groupBy(*keys).agg(count.cast("long").alias("n"))
    if not within:
        total = tally.select(F.sum("n")).scalar()
        return tally.withColumn("percent", F.col("n") / total)
    totals = tally.groupBy(*renamed(within)).agg(F.sum("n").alias("_total"))
    return tally.join(totals, same_group(within)).select(
        *tally.columns, (F.col("n") / F.col("_total")).alias("percent")
    )


def positive_share(df: DataFrame, flag: str, label: str) -> DataFrame:
    """Share of all rows that are positive, per value of the flag."""
    return share(df, [flag, label]).where(F.col(label)).drop(label)


def contingency(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """2 x 2 table of two conditions; rows where either is unknown are left out."""
    cells = df.select(row.alias("predicted"), column.alias("actual")).dropna()
    return cells.groupBy("predicted").agg(
        F.count_if(~F.col("actual")).cast("long").alias("negative"),
        F.count_if("actual").cast("long").alias("positive"),
    )


def standardized(df: DataFrame, x: str, out: str) -> DataFrame:
    """Centre by the mean and divide by the sample standard deviation."""
    moments = df.select(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))).scalar()
    centred = F.col(x) - moments.getField("mean")
    return df.withColumn(out, F.try_divide(centred, moments.getField("sd")))


def histogram(
    df: DataFrame, x: Column, width: float, by: Sequence[str] = (),
    low: float | None = None, high: float | None = None,
) -> DataFrame:
    """Rows per bin of ``width``. Values outside [low, high] are dropped, as axis limits do."""
    values = df.select(*by, x.cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    if low is not None:
        values = values.where(F.col("_x") >= low)
    if high is not None:
        values = values.where(F.col("_x") <= high)
    return (
        values.withColumn("bin", F.floor(F.col("_x") / width).cast("long"))
        .groupBy(*by, "bin")
        .agg(F.count("*").cast("long").alias("n"))
    )


def density_profile(
    df: DataFrame, x: Column, by: str, low: float, high: float, bins: int = 50
) -> DataFrame:
    """Binned density of a (transformed, clipped) measure for each value of ``by``."""
    width = (high - low) / bins
    counts = histogram(df, x - low, width, [by], 0.0, high - low).select(
        by, F.least("bin", F.lit(bins - 1)).cast("long").alias("bin"), "n"
    )
    counts = counts.groupBy(by, "bin").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(*renamed([by])).agg(F.sum("n").alias("_total"))
    return counts.join(totals, same_group([by])).select(
        by, "bin", "n",
        (F.lit(low) + (F.col("bin") + 0.5) * width).alias("mid"),
        (F.col("n") / (F.col("_total") * width)).alias("density"),
    )


def smooth_density(
    profile: DataFrame, by: str, low: float, high: float, points: int = 128
) -> DataFrame:
    """Gaussian kernel curve over a binned profile.

    The profile holds at most a fixed number of bins per group, so expanding each
    bin over the grid points is bounded whatever the size of the data behind it.
    The bandwidth is the rule of thumb 0.9 * sd * n^(-1/5) on the binned values.
    """
    mean = F.sum(F.col("n") * F.col("mid")) / F.sum("n")
    second = F.sum(F.col("n") * F.col("mid") * F.col("mid")) / F.sum("n")
    scale = profile.groupBy(*renamed([by])).agg(
        F.sum("n").alias("_total"),
        (0.9 * F.sqrt(F.greatest(second - mean * mean, F.lit(1e-12)))
         * F.pow(F.sum("n").cast("double"), F.lit(-0.2))).alias("_h"),
    )
    step = (high - low) / (points - 1)
    grid = (
        profile.join(scale, same_group([by]))
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.lit(low) + F.col("point") * step)
    )
    z = (F.col("x") - F.col("mid")) / F.col("_h")
    weight = F.col("n") / (F.col("_total") * F.col("_h")) * F.exp(-0.5 * z * z)
    return grid.groupBy(by, "point", "x").agg(
        (F.sum(weight) / F.sqrt(F.lit(2.0) * F.pi())).alias("density")
    )


def ecdf(df: DataFrame, x: str, by: str) -> DataFrame:
    """Cumulative share of rows at or below each value, per group."""
    tally = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count("*").alias("n"))
    steps = running_totals(tally, x, ["n"], [by])
    return steps.select(by, x, ((F.col("n_before") + F.col("n")) / F.col("n_total")).alias("cdf"))


def label_correlations(df: DataFrame, measures: Mapping[str, Column], label: str) -> DataFrame:
    """Pearson correlation of every measure with a 0/1 label, in one pass."""
    y = F.col(label).cast("double")
    row = df.agg(*[F.corr(x.cast("double"), y).alias(name) for name, x in measures.items()])
    return row.unpivot([], list(measures), "term", "correlation")


def exact_quantiles(
    df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, as array ``quantiles`` per group.

    Values are collapsed to distinct ones with their counts; running totals then
    tell which value holds each needed rank. Nothing is gathered per group beyond
    the few ranks asked for. ``weight`` says that rows already are counts. NULL and NaN
    are left out.
    """
    size = F.sum(weight) if weight else F.count("*")
    tally = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*by, x).agg(size.cast("long").alias("n"))
    steps = running_totals(tally, x, ["n"], by)

    def value_at(rank: Column) -> Column:
        holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(holds, F.col(x).cast("double")))

    points = []
    for p in probs:
        position = (F.col("n_total") - 1) * F.lit(float(p))
        below, above = value_at(F.floor(position)), value_at(F.ceil(position))
        part = F.max(position - F.floor(position))
        points.append(below + (above - below) * part)
    return steps.groupBy(*by).agg(F.array(*points).alias("quantiles"))


#: Size parameter of a sketch: its rank error is about 2.3 / SKETCH_SIZE^0.9 at a confidence of 99 %.
SKETCH_SIZE = 800


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """(by, ``variable``, ``sketch``): a mergeable sketch of every column from one pass over the rows.

    Rows are neither copied nor shuffled, only sketches are. Sketches of parts of the data (a day,
    a partition) can be kept and merged later. NULL and NaN are left out.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    sketches = [F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(size)).alias(f"__{c}") for c, x in values.items()]
    one = df.groupBy(*by).agg(*sketches)
    cells = [F.struct(F.lit(c).alias("variable"), F.col(f"__{c}").alias("sketch")) for c in columns]
    return one.select(*by, F.inline(F.array(*cells)))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, ``variable``, ``n``, ``quantiles``) of merged sketches; NULL where no value was seen."""
    merged = sketches.groupBy(*by, "variable").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    n = F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0))
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return merged.select(*by, "variable", n.cast("long").alias("n"), F.when(n > 0, found).alias("quantiles"))


def growth_extremes(slopes: DataFrame, weekly: DataFrame, k: int = 15) -> DataFrame:
    """Series of the ``k`` users with the steepest growth and the ``k`` with the steepest fall."""
    top = slopes.orderBy(F.desc("estimate"), "user_id").limit(k).withColumn("side", F.lit("top"))
    bottom = slopes.orderBy("estimate", "user_id").limit(k).withColumn("side", F.lit("bottom"))
    chosen = top.unionByName(bottom).select("user_id", "estimate", "side")
    # At most 2k rows by construction, so the broadcast is bounded.
    return weekly.join(F.broadcast(chosen), "user_id")
