"""Boosted-tree demand model with penalised leaves: fit, predict, importance, tune, save, load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlib.operators import boost
from martlib.operators.panel import BASE_FEATURES, DATE, SERIES, TARGET
from martlib.storage import path_exists

PREDICTION = "y_pred"
RAW_PREDICTION = "raw_prediction"

# Readable names of features.
LABELS = {
    "lag_1": "Last Week's Sales (lag t-1)",
    "lag_2": "2 Weeks Ago (lag t-2)",
    "lag_4": "4 Weeks Ago (lag t-4)",
    "lag_8": "8 Weeks Ago (lag t-8)",
    "rolling_mean_4": "4-Week Moving Average",
    "rolling_mean_8": "8-Week Moving Average",
    "rolling_std_4": "4-Week Sales Volatility",
    "week_number": "Week of Year (Seasonality)",
    "month_number": "Month (Seasonality)",
    "quarter": "Quarter (Seasonality)",
    "calendar_year": "Year (Long-term Trend)",
    "platform_Shopify": "Platform: Shopify vs Retail",
}


@dataclass(frozen=True)
class GbtParams:
    """Fixed default values of the model; ``bins`` is the number of quantiles tried per feature."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    min_rows: int = 2
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 64
    seed: int = 42


# The full tuning grid, 108 combinations.
GRID = {
    "trees": [100, 200, 300],
    "depth": [3, 4, 5],
    "rate": [0.01, 0.05, 0.1],
    "row_share": [0.7, 0.8],
    "column_share": [0.7, 0.8],
}


TABLE = boost.Table(BASE_FEATURES, SERIES, TARGET, DATE)

_ROW = "_feature_row"

NODES = (
    "tree int, node int, feature string, number int, is_category boolean, threshold double, "
    "category string, gain double, row_count long, value double"
)
_SHAPES = "array<struct<c:array<int>,k:array<boolean>,t:array<double>,v:array<double>>>"


@dataclass(frozen=True)
class TreeModel:
    """Trees as rows of NODES: splits with their gain, leaves with the value they add.

    The children of node i are 2i + 1 (below the threshold, or any other category) and 2i + 2.
    Values are scaled by the learning rate; a prediction is ``intercept`` and one leaf per tree.
    """

    params: GbtParams
    intercept: float
    names: list[list[str]]
    nodes: list[tuple]

    @property
    def trees(self) -> int:
        return len({n[0] for n in self.nodes})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODES)


def _nodes(trees: list[boost.Tree], layout: boost.Layout) -> list[tuple]:
    """Rows of NODES from heaps; what only hands values down is left out."""
    rows, numbers = [], len(layout.edges)
    for number, tree in enumerate(trees):
        reached = [0]
        while reached:
            at = reached.pop()
            column = int(tree.column[at]) if at < len(tree.column) else -1
            rows_in, value = int(tree.rows[at]), float(tree.value[at])
            if column < 0:
                rows.append((number, at, None, None, None, None, None, None, rows_in, value))
                continue
            place, gain = int(tree.bin[at]), float(tree.gain[at])
            if column < numbers:
                split = (BASE_FEATURES[column], column, False, float(layout.edges[column][place]), None)
            else:
                name = layout.names[column - numbers][place]
                split = (f"{SERIES[column - numbers]}_{name}", column, True, float(place), name)
            rows.append((number, at, *split, gain, rows_in, None))
            reached += [2 * at + 2, 2 * at + 1]
    return sorted(rows, key=lambda r: r[:2])


def fit_gbt(train: DataFrame, params: GbtParams = GbtParams()) -> TreeModel:
    """Distributed fit; ``train`` should be a written table, so each pass is a cheap scan."""
    trees, layouts, _ = boost.boost(train, TABLE, [(boost.Fold(), params)], params.bins)
    return TreeModel(params, float(layouts[0].mean), layouts[0].names, _nodes(trees[0], layouts[0]))


def _with_row(model: TreeModel, df: DataFrame) -> DataFrame:
    """Adds the array that the trees read: panel features, and per series column its value's number."""

    def code(column: str, names: list[str]) -> Column:
        known = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        return (F.coalesce(F.array_position(known, F.col(column)), F.lit(0)) - 1).cast("double")

    numbers = [F.col(c).cast("double") for c in BASE_FEATURES]
    return df.withColumn(_ROW, F.array(*numbers, *[code(c, names) for c, names in zip(SERIES, model.names)]))


def _score(model: TreeModel) -> Column:
    """The trees as one expression of the array, of the same size for any number of trees."""
    if not model.nodes:
        return F.lit(model.intercept)
    size = 2 ** (model.params.depth + 1) - 1
    shapes: dict[int, dict] = {}
    for tree, node, _, number, category, threshold, _, _, _, value in model.nodes:
        shape = shapes.setdefault(tree, {"c": [-1] * size, "k": [False] * size, "t": [0.0] * size, "v": [0.0] * size})
        if number is None:
            while node < size:  # a leaf's value stands on every level below, on the left
                shape["v"][node] = value
                node = 2 * node + 1
        else:
            shape["c"][node], shape["k"][node], shape["t"][node] = number, category, threshold
    trees = F.from_json(F.lit(json.dumps([shapes[t] for t in sorted(shapes)])), _SHAPES)

    levels = F.sequence(F.lit(1), F.lit(model.params.depth))

    def leaf(t: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            column, limit = F.get(t["c"], at), F.get(t["t"], at)
            x = F.get(F.col(_ROW), column)
            right = F.when(column < 0, False).when(F.get(t["k"], at), x == limit).otherwise(x >= limit)
            return at * 2 + 1 + F.coalesce(right, F.lit(False)).cast("int")

        return F.aggregate(levels, F.lit(0), down)

    return F.aggregate(trees, F.lit(model.intercept), lambda total, t: total + F.get(t["v"], leaf(t)))


def predict(model: TreeModel, df: DataFrame) -> DataFrame:
    """Adds ``y_pred``, never below zero."""
    return _with_row(model, df).withColumn(PREDICTION, F.greatest(_score(model), F.lit(0.0))).drop(_ROW)


def predict_raw(model: TreeModel, df: DataFrame) -> DataFrame:
    """Adds ``raw_prediction``, which may be negative."""
    return _with_row(model, df).withColumn(RAW_PREDICTION, _score(model)).drop(_ROW)


def feature_columns(model: TreeModel) -> list[str]:
    """Names of the features: panel features, then one per value of a series column but the first."""
    return BASE_FEATURES + [f"{c}_{x}" for c, names in zip(SERIES, model.names) for x in names[1:]]


def feature_importance(model: TreeModel, spark: SparkSession, digits: int = 2) -> DataFrame:
    """Mean gain per split of the features in use, largest first, with splits, share and labels."""
    splits = model.table(spark).where("feature IS NOT NULL")
    table = splits.groupBy("feature").agg(
        F.avg("gain").alias("gain"), F.count("*").alias("splits"), F.sum("gain").alias("sum")
    )
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    named = F.try_element_at(F.create_map(*pairs), F.col("feature"))
    region = F.when(
        F.col("feature").startswith("region_"),
        F.concat(F.lit("Region: "), F.regexp_replace("feature", "^region_", "")),
    )
    return table.select(
        "feature",
        F.round("gain", digits).alias("gain"),
        "splits",
        F.round(F.col("sum") / F.sum("sum").over(Window.partitionBy()), digits).alias("share"),
        F.coalesce(named, region, F.col("feature")).alias("label"),
    ).orderBy(F.desc("gain"), "feature")


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Week boundaries of time-ordered folds: fold, test_from, test_to; training is all before.

    With W distinct weeks and block size t = W div (folds + 1), fold i tests weeks
    [W - (folds - i)t, W - (folds - i - 1)t). The window runs over distinct weeks, a
    calendar-sized table.
    """
    weeks = df.select(DATE).distinct()
    ranked = weeks.select(DATE, F.row_number().over(Window.orderBy(DATE)).alias("rank"))
    total = weeks.agg(F.count("*")).scalar()
    blocks = ranked.withColumn("total", total).withColumn(
        "block", F.floor(F.col("total") / (folds + 1))
    )
    from_end = F.floor(F.try_divide(F.col("total") - F.col("rank"), F.col("block")))
    numbered = blocks.withColumn("fold", (folds - 1 - from_end).cast("int"))
    return (
        numbered.filter(F.col("fold") >= 0)
        .groupBy("fold")
        .agg(
            F.min(DATE).alias("test_from"),
            F.max(DATE).alias("test_to"),
            F.count("*").alias("test_weeks"),
        )
    )


def tune(train: DataFrame, grid: dict = GRID, folds: int = 5) -> tuple[GbtParams, DataFrame]:
    """Grid search by mean fold MAE. Returns the best parameters and the score table.

    All parameter sets and folds are boosted together. A boosted ensemble cut after n trees is
    the ensemble of n trees, so the largest one answers for every number of trees.
    """
    spark = train.sparkSession
    bounds = expanding_folds(train, folds).orderBy("fold").collect()  # one row per fold
    if not bounds:
        raise ValueError(f"tuning on {folds} folds needs at least {folds + 1} weeks")
    counts = grid.get("trees", [GbtParams.trees])
    others = {k: v for k, v in grid.items() if k != "trees"}
    sets = [replace(GbtParams(**dict(zip(others, values))), trees=max(counts)) for values in product(*others.values())]
    jobs = [(boost.Fold(b.test_from, b.test_to), p) for p in sets for b in bounds]
    _, _, errors = boost.boost(train, TABLE, jobs, GbtParams.bins, counts)
    keys = ["trees", "depth", "rate", "row_share", "column_share"]
    rows = [
        tuple(asdict(replace(jobs[m][1], trees=n))[k] for k in keys) + (error,) for (m, n), error in sorted(errors.items())
    ]
    table = spark.createDataFrame(
        rows, "trees int, depth int, rate double, row_share double, column_share double, mae double"
    )
    scores = table.groupBy(*keys).agg(F.avg("mae").alias("mean_mae"), F.count("*").alias("folds"))
    best = scores.orderBy("mean_mae", *keys).select(*keys).first()
    return GbtParams(**best.asDict()), scores


def save_model(spark: SparkSession, model: TreeModel, path: str) -> None:
    """The tree table, and one row of settings, under a folder."""
    settings = (json.dumps(asdict(model.params)), model.intercept, model.names)
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    frame = spark.createDataFrame([settings], "params string, intercept double, names array<array<string>>")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> TreeModel:
    if not path_exists(spark, f"{path}/settings"):
        raise FileNotFoundError(f"no model at {path}; fit and save one first")
    row = spark.read.parquet(f"{path}/settings").first()
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()  # as large as the model
    return TreeModel(GbtParams(**json.loads(row.params)), row.intercept, [list(n) for n in row.names], [tuple(n) for n in nodes])
