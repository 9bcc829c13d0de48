"""Model inputs, a pooled regression model, and market regimes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.clean import finite, numeric_columns, quantiles
from tidebars.operators.indicators import Indicator, with_indicators
from tidebars.series import (
    BLOCK_ROWS,
    CHUNK,
    SERIES,
    block_window,
    drop_staged,
    join_keys,
    require_columns,
    staged,
    staged_paths,
    trailing,
    with_chunk,
    with_position,
    with_series_values,
)

TARGETS = ("returns", "trend_strength", "atr")
NOT_FEATURES = ("returns", "log_returns")
SCORES = ("p0", "p1", "p2")


def feature_target(df: DataFrame, horizon: int = 0, keys: Sequence[str] = SERIES) -> DataFrame:
    """``features`` (all numeric columns but the returns) and ``target``.

    The target is of the same row, or ``horizon`` rows ahead.  A null, NaN or
    infinite value is an error.
    """
    require_columns(df, TARGETS)
    names = sorted(numeric_columns(df, NOT_FEATURES))

    def checked(columns: Sequence[str]) -> Column:
        values = F.array(*[finite(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("double") for c in columns])
        bad = F.exists(values, lambda v: v.isNull())
        return F.when(bad, F.raise_error(F.lit("null or infinite model input"))).otherwise(values)

    if horizon == 0:
        return df.select(*keys, "ts", checked(names).alias("features"), checked(TARGETS).alias("target"))
    # Seen from the row of the target: the features of a row before it in its block.
    block = block_window(keys)
    here = {"_features": checked(names), "target": checked(TARGETS)}
    before = {"features": F.lag("_features", horizon).over(block), "_ts": F.lag("ts", horizon).over(block)}
    shifted = Indicator(("features", "target", "_ts"), (here, before), horizon)
    found = with_indicators(with_position(df, keys), shifted, keys=keys).filter(F.col("pos") >= horizon)
    return found.select(*keys, F.col("_ts").alias("ts"), "features", "target")


def chronological_split(df: DataFrame, share: float = 0.8, keys: Sequence[str] = SERIES) -> DataFrame:
    """``is_train``: true for the first ``int(share * n)`` rows of each series."""
    numbered = with_position(df, keys)
    return numbered.withColumn("is_train", F.col("pos") < F.floor(F.col("n") * share)).drop("pos", "n")


def sequences(df: DataFrame, length: int = 20, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """``sequence``: the last ``length`` feature arrays up to each row that has as many."""
    window = trailing(length, keys)
    gathered = Indicator(("sequence",), ({"sequence": F.collect_list("features").over(window)},), length)
    return with_indicators(df, gathered, keys=keys, rows=rows).filter(F.size("sequence") == length)


def fit_signal_model(
    train: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS, ridge: float = 1e-6
) -> PipelineModel:
    """One linear model per target, shared by all series, as one analysis."""
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")]
    for target, score in zip(targets, SCORES):
        stages.append(
            LinearRegression(featuresCol="_features", labelCol=target, predictionCol=score, regParam=ridge)
        )
    return Pipeline(stages=stages).fit(train)


def score_signal_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with scores ``p0, p1, p2``."""
    return model.transform(df).drop("_features")


def model_losses(model: PipelineModel, df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Mean squared error of each score on the training and validation rows.

    One pass: ``df`` holds both kinds of rows, told apart by ``is_train``.
    """
    scored = model.transform(df)
    errors = [F.avg(F.pow(F.col(t) - F.col(s), 2)).alias(t) for t, s in zip(targets, SCORES)]
    part = F.when(F.col("is_train"), "train").otherwise("validation").alias("part")
    return scored.groupBy(part).agg(*errors).unpivot("part", list(targets), "target", "mse")


def directional_accuracy(
    df: DataFrame, predicted: str, actual: str, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Share of rows where prediction and outcome have the same sign."""
    same = F.signum(predicted) == F.signum(actual)
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)).alias("accuracy")
    )


#: A centre rests when it moves by less than this many deviations.
SETTLED = 1e-9
REGIME_FEATURES = ("volatility", "trend_strength", "volume")


def _standardised(df: DataFrame, features: Sequence[str], keys, rows) -> DataFrame:
    """``_x``: the features with mean 0 and deviation 1 in their series, and ``_n``."""
    moments = {}
    for i, f in enumerate(features):
        moments[f"_s{i}"] = (F.sum, F.sum(f))
    known = with_series_values(df, moments | {"_n": (F.sum, F.count(F.lit(1)))}, keys, rows)
    centred = known.withColumns({f"_c{i}": F.col(f) - F.col(f"_s{i}") / F.col("_n") for i, f in enumerate(features)})
    squares = {f"_q{i}": (F.sum, F.sum(F.col(f"_c{i}") * F.col(f"_c{i}"))) for i in range(len(features))}
    spread = with_series_values(centred, squares, keys, rows)
    scaled = [
        F.when(F.col(f"_q{i}") > 0, F.col(f"_c{i}") / F.sqrt(F.col(f"_q{i}") / F.col("_n"))).otherwise(0.0)
        for i in range(len(features))
    ]
    return spread.select(*keys, "ts", "_n", F.array(*scaled).alias("_x"))


def _distance(x: Column, centre: Column) -> Column:
    squares = F.zip_with(x, centre, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, v: total + v)


def _nearest(x: Column, centres: Column) -> Column:
    """Distance and number, ``(d, c)``, of the nearest of an array of centres."""
    return F.array_min(F.transform(centres, lambda e: F.struct(_distance(x, e["at"]).alias("d"), e["c"].alias("c"))))


def market_regime(
    df: DataFrame,
    max_k: int = 5,
    features: Sequence[str] = REGIME_FEATURES,
    keys: Sequence[str] = SERIES,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``regime``: k-means cluster of each row within its series.

    k is the first whose next value lowers the inertia by less than a fifth,
    else 1.  All series and all k are clustered together: an iteration is one
    pass that sums up points per (series, k, cluster) before the shuffle, so
    neither many series nor one long series is a special case.  Passes go on
    until no centre moves; a centre that loses all its points stays where it is.
    The first centres are the means of equal shares of the points, in the order
    of the sum of their coordinates.  Clusters are
    numbered along the first feature.  Rows with a null feature get null; a
    series with fewer than ``max_k`` complete rows gets 0 throughout.
    """
    require_columns(df, features)
    present = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    points = staged(with_chunk(_standardised(df.filter(present), features, keys, rows), rows), "points")
    chunk_keys = [*keys, CHUNK]
    enough = points.filter(F.col("_n") >= max_k)
    chunks = staged(enough.select(*chunk_keys).distinct(), "chunks")
    dims, ks = len(features), range(2, max_k + 1)

    cuts = sorted({i / k for k in ks for i in range(1, k)})
    along = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v)
    # Exact cuts: the start, and so the clusters, are the same however the rows are dealt out.
    spots = quantiles(enough.select(*keys, along.alias("_along")), ["_along"], cuts, keys)
    spots = spots.select(*keys, F.array(*[f"_along_q{i}" for i in range(len(cuts))]).alias("_cuts"))
    means = F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(dims)]).alias("at")
    members = F.collect_list(F.struct("k", "c", "at")).alias("_centres")

    def share(k: int) -> Column:
        passed = [(along > F.get("_cuts", F.lit(cuts.index(i / k)))).cast("int") for i in range(1, k)]
        return F.struct(F.lit(k).alias("k"), sum(passed, F.lit(0)).alias("c"))

    dealt = join_keys(enough, join_keys(chunks, spots, keys), chunk_keys)
    dealt = dealt.select(*keys, "_x", F.explode(F.array(*[share(k) for k in ks])).alias("_a")).select(*keys, "_x", "_a.*")
    centres = staged(dealt.groupBy(*keys, "k", "c").agg(means).groupBy(*keys).agg(members), "centres")

    near = F.array(
        *[
            F.struct(F.lit(k).alias("k"), _nearest(F.col("_x"), F.filter("_centres", lambda e: e["k"] == k)).alias("near"))
            for k in ks
        ]
    )
    nearest = F.explode(near).alias("_a")
    def assigned(table: DataFrame) -> DataFrame:
        joined = join_keys(enough, join_keys(chunks, table, keys), chunk_keys)
        return joined.select(*keys, "_x", nearest).select(*keys, "_x", "_a.k", "_a.near.*")

    moving, moves = True, None
    while moving:
        found = assigned(centres).groupBy(*keys, "k", "c").agg(means).withColumnRenamed("at", "_to")
        held = centres.select(*keys, F.inline("_centres"))
        moved = join_keys(held, found, [*keys, "k", "c"], "left").withColumn("_to", F.coalesce("_to", "at"))
        moved, earlier = staged(moved, "moved"), moves
        moves = staged_paths(df.sparkSession)[-1]
        drop_staged(df.sparkSession, [earlier] if earlier else [])  # the centres before these aren't read again
        far = moved.agg(F.max(_distance(F.col("at"), F.col("_to")))).first()[0]  # one number
        moving = far is not None and far > SETTLED * SETTLED
        centres = moved.withColumn("at", F.col("_to")).groupBy(*keys).agg(members)  # a row per centre is read again
    inertia = assigned(centres).groupBy(*keys, "k").agg(F.sum("d").alias("inertia"))
    # One cluster: the squared distance of standardised points from 0.
    length = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)
    single = enough.groupBy(*keys).agg(F.sum(length).alias("inertia")).withColumn("k", F.lit(1))
    ladder = Window.partitionBy(*keys).orderBy("k")
    steps = inertia.unionByName(single).withColumn("_before", F.lag("inertia").over(ladder))
    small = (F.col("_before") != 0) & (F.col("_before") - F.col("inertia") < F.col("_before") * 0.2)
    elbow = steps.groupBy(*keys).agg(F.coalesce(F.min(F.when(small, F.col("k") - 1)), F.lit(1)).alias("_k"))
    ordered = F.array_sort(
        F.transform(
            F.filter("_centres", lambda e: e["k"] == F.col("_k")), lambda e: F.struct(e["at"].alias("at"), e["c"].alias("c"))
        )
    )
    chosen = join_keys(centres, elbow, keys).select(*keys, ordered.alias("_centres"))
    labelled = join_keys(points, join_keys(chunks, chosen, keys), chunk_keys, "left")
    mine = _nearest(F.col("_x"), F.col("_centres"))["c"]
    place = F.array_position(F.transform("_centres", lambda e: e["c"]), mine) - 1
    clustered = F.coalesce(F.size("_centres") > 0, F.lit(False))
    labels = labelled.select(*keys, "ts", F.when(clustered, place).otherwise(0).cast("int").alias("regime"))
    joined = join_keys(df, labels, [*keys, "ts"], "left")
    # A series too short to cluster is regime 0 also where features are null.
    counts = with_series_values(joined, {"_ok": (F.sum, F.count("regime"))}, keys, rows)
    return counts.withColumn("regime", F.when(F.col("_ok") < max_k, F.lit(0)).otherwise(F.col("regime"))).drop("_ok")
