"""Fitted feature preparation: category levels, standardisation and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    FeatureHasher, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
    VectorSlicer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.session import stage

FEATURES = "features"


def training_rows(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Complete rows of the model's own columns, staged once for all passes of a fit.

    Only the listed columns decide completeness: a live subscription has no
    cancellation date and must not be lost for it.
    """
    wanted = [c for c in dict.fromkeys([*columns, label]) if c in df.columns]
    # Columns that are known to be filled are not asked again; a wide check would compute every one of them twice.
    rows = df.select(*wanted)
    asked = [f.name for f in rows.schema if f.nullable or isinstance(f.dataType, T.FractionalType)]
    return stage((rows.dropna(subset=asked) if asked else rows).withColumn(label, F.col(label).cast("double")))


def spread(rows: DataFrame) -> DataFrame:
    """Staged rows, dealt evenly over the cores if they lie in fewer partitions than there are cores.

    A fit keeps the partitions of its rows through all its passes.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else stage(rows.repartition(cores))


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def fit_design(
    train: DataFrame,
    features: Sequence[str],
    scaled: Sequence[str] = (),
    scale_all: bool = False,
    one_hot: bool = True,
    hashed: Sequence[str] = (),
    hash_slots: int = 256,
) -> tuple[list[Transformer], list[str]]:
    """Fitted stages that turn raw columns into a feature vector, and its slot names.

    Text columns become indicators against their alphabetically first level; a value
    not seen in training, or missing, reads as that baseline. With ``one_hot=False``
    they stay category indices, which is what tree models split on. Missing numbers
    become NaN, so such rows keep their place and get no score.

    Levels of text columns are kept on the driver and in the model. Columns with very many
    levels belong in ``hashed``: they share ``hash_slots`` hashed indicators instead.
    """
    stages: list[Transformer] = []
    names: list[str] = []
    inputs: list[str] = []
    text = [f for f in features if _is_text(train, f) and f not in hashed]
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol="__hashed", numFeatures=hash_slots, categoricalCols=list(hashed)))
        inputs.append("__hashed")
        names += [f"hashed_{i}" for i in range(hash_slots)]
    if scaled:
        together = VectorAssembler(inputCols=list(scaled), outputCol="__scaled_raw", handleInvalid="keep")
        scaler = StandardScaler(inputCol="__scaled_raw", outputCol="__scaled", withMean=True, withStd=True).fit(together.transform(train))
        stages += [together, scaler]
    levels: dict[str, list[str]] = {}
    if text:
        indexer = StringIndexer(
            inputCols=text, outputCols=[f"{c}__index" for c in text],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ).fit(train)
        levels = dict(zip(text, indexer.labelsArray, strict=True))
        stages.append(indexer)
        if one_hot:
            encoder = OneHotEncoder(
                inputCols=[f"{c}__index" for c in text], outputCols=[f"{c}__levels" for c in text],
                dropLast=False,
            ).fit(indexer.transform(train))
            stages.append(encoder)
    for feature in features:
        if feature in levels and not one_hot:
            inputs.append(f"{feature}__index")
            names.append(feature)
        elif feature in levels:
            others = list(levels[feature])[1:]
            if others:
                stages.append(
                    VectorSlicer(
                        inputCol=f"{feature}__levels", outputCol=f"{feature}__slots",
                        indices=list(range(1, len(others) + 1)),
                    )
                )
                inputs.append(f"{feature}__slots")
                names += [f"{feature}_{level}" for level in others]
        elif feature in hashed:
            continue
        elif feature in scaled:
            stages.append(
                VectorSlicer(inputCol="__scaled", outputCol=f"{feature}__scaled", indices=[list(scaled).index(feature)])
            )
            inputs.append(f"{feature}__scaled")
            names.append(f"scale({feature})")
        else:
            inputs.append(feature)
            names.append(feature)
    assembled = f"{FEATURES}__raw" if scale_all else FEATURES
    stages.append(VectorAssembler(inputCols=inputs, outputCol=assembled, handleInvalid="keep"))
    if scale_all:
        prepared = PipelineModel(stages).transform(train)
        stages.append(
            StandardScaler(
                inputCol=assembled, outputCol=FEATURES, withMean=True, withStd=True
            ).fit(prepared)
        )
    return stages, names


def log_stage(zero_based: Sequence[str], positive: Sequence[str]) -> SQLTransformer:
    """Log columns: ln(x + 1) for counts from zero, ln(x) with 0 for x = 0 otherwise."""
    columns = [f"ln(`{c}` + 1) AS `log_{c}`" for c in zero_based]
    columns += [f"if(`{c}` = 0, 0.0D, ln(`{c}`)) AS `log_{c}`" for c in positive]
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")


def known(x: Column) -> Column:
    """NULL instead of NaN, for rows that could not be scored."""
    return F.when(~F.isnan(x), x)
