"""Terrain classes: features, rule labels, stratified samples, forest, metrics."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selenogrid.functions.numeric import or_one, zero_if_null
from selenogrid.operators.quantiles import ordered_index
from selenogrid.session import write_table

FEATURES = ["elev_n", "slope_n", "rough_n", "quality_n", "mean_slope", "std_elev", "grad_slope", "lat_n"]
N_CLASSES = 5
#: Trees of one fit; the fits run side by side.
BATCH_TREES = 10
#: Training rows of one task. Every task of a fit holds, writes and merges counts for each node, empty or not, so few rows a task cost most.
TASK_ROWS = 250_000


def features(layers: DataFrame) -> DataFrame:
    """Eight features of every cell; nodata counts as 0."""
    span = F.greatest(F.col("elevation_max") - F.col("elevation_min"), F.lit(1e-6))
    return layers.select(
        "region", "row", "col",
        zero_if_null((F.col("elevation") - F.col("elevation_min")) / span).alias("elev_n"),
        zero_if_null(F.col("slope") / 90.0).alias("slope_n"),
        zero_if_null(F.col("roughness") / or_one(F.col("roughness_max"))).alias("rough_n"),
        F.when(F.col("has_quality"), zero_if_null(F.col("quality"))).otherwise(1.0).alias("quality_n"),
        "mean_slope", "std_elev", "grad_slope", (-(F.col("lat") + 90.0) / 10.0).alias("lat_n"),
    )


def rule_label(slope: Column, roughness: Column, safety: Column, mission: Column, final: Column) -> Column:
    """Strongest rule first; comparison with nodata is false."""
    return (
        F.when((slope > 25.0) | (roughness > 200.0), 0)
        .when((mission > 0.7) & (safety > 0.3), 4)
        .when((safety > 0.6) & (final > 0.5), 3)
        .when((safety >= 0.3) & (safety <= 0.6), 2)
        .otherwise(1)
    )


def labelled(layers: DataFrame, scores: DataFrame) -> DataFrame:
    """Features with the rule label of the given mission's scores."""
    key = ["region", "row", "col"]
    label = rule_label(*[F.col(c) for c in ("slope", "roughness", "safety", "mission", "final")])
    return features(layers).join(scores.select(*key, label.alias("label")), key)


def _placed(df: DataFrame, seed: int) -> DataFrame:
    """``_pos``: the row's place among those of its class in a seeded order, counted slice by slice, so no class is gathered in one task."""
    work = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "region", "row", "col")))
    slices = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    return ordered_index(work, ["label"], slices, ["_h", "region", "row", "col"], "_pos").drop("_h")


def stratified(df: DataFrame, n_train: int = 50_000, n_val: int = 10_000, seed: int = 42) -> DataFrame:
    """``fold``: train, validation or NULL, every class in proportion and the two always apart.

    The sizes are bounds: with fewer rows than both together, all are used, in the same proportion.
    """
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"))
    used = F.least(F.lit(1.0), (n_train + n_val) / F.col("_all"))
    cuts = counts.join(whole, F.lit(True)).select(  # one row for each class
        "label", F.floor(F.col("_n") * used * (n_train / (n_train + n_val)) + 0.5).alias("_train"), F.floor(F.col("_n") * used + 0.5).alias("_used"))
    fold = F.when(F.col("_pos") < F.col("_train"), "train").when(F.col("_pos") < F.col("_used"), "validation")
    return _placed(df, seed).join(cuts, "label").withColumn("fold", fold).select(*df.columns, "fold")


def folds(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds that differ by at most one row per class."""
    return _placed(df, seed).withColumn("fold", F.col("_pos") % k).drop("_pos")


def with_weights(df: DataFrame) -> DataFrame:
    """Balanced class weights: rows / (classes present x rows of the class)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    share = counts.join(whole, F.lit(True)).select("label", (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return df.join(share, "label")


def train(df: DataFrame, trees: int = 100, depth: int = 15, seed: int = 42) -> PipelineModel:
    """A forest in batches of trees, grown side by side on the same rows; the last stage puts the batches' votes beside each other."""
    spark = df.sparkSession
    data = write_table(with_weights(df).select("label", "weight", *FEATURES), "training")
    tasks = max(1, -(-data.count() // TASK_ROWS))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(data).select("label", "weight", "features").repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(first: int):
        return RandomForestClassifier(
            labelCol="label", featuresCol="features", weightCol="weight", numTrees=min(BATCH_TREES, trees - first), maxDepth=depth, maxBins=256,
            maxMemoryInMB=256, cacheNodeIds=True, seed=seed + 1000 * first, rawPredictionCol=f"votes_{first}", probabilityCol="", predictionCol="").fit(rows)

    starts = range(0, trees, BATCH_TREES)
    pool = ThreadPool(len(starts))
    try:
        rows.count()  # kept once, for all batches
        batches = pool.map(inheritable_thread_target(spark)(fit), starts, chunksize=1)
    finally:
        pool.terminate()
        rows.unpersist()
    return PipelineModel([assembler, *batches, VectorAssembler(inputCols=[f"votes_{first}" for first in starts], outputCol="votes")])


def batches_of(model: PipelineModel) -> list:
    return model.stages[1:-1]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """A class for every cell, the one that all trees together give most votes; no size limit."""
    batches = batches_of(model)
    n = batches[0].numClasses
    out = model.transform(df).select(*df.columns, vector_to_array("votes").alias("_votes"))
    total = F.array(*[sum(F.col("_votes")[b * n + c] for b in range(len(batches))) for c in range(n)])
    out = out.select(*df.columns, total.alias("_total"))
    return out.select(*df.columns, (F.array_position("_total", F.array_max("_total")) - 1).cast("int").alias("cls"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved model, or None where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return PipelineModel.load(path)


def importances(spark: SparkSession, model: PipelineModel, top: int = 3) -> DataFrame:
    batches = batches_of(model)
    trees = sum(b.getNumTrees for b in batches)
    values = [float(v) for v in sum(b.featureImportances.toArray() * (b.getNumTrees / trees) for b in batches)]
    rows = spark.createDataFrame(list(zip(FEATURES, values, strict=True)), "feature STRING, importance DOUBLE")
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def confusion(df: DataFrame, truth: str, guess: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def metrics(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and the F1 of every class; 0 for a class without members or hits."""
    total = matrix.groupBy(*by).agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"))
    sides = F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"),
                 F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("guess").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h"))))
    per = matrix.select(*by, sides.alias("x")).groupBy(*by, "x.cls").agg(
        F.sum("x.t").alias("t"), F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))
    f1 = F.when(F.col("t") + F.col("g") > 0, 2.0 * F.col("h") / (F.col("t") + F.col("g"))).otherwise(0.0)
    joined = per.join(total, list(by)) if by else per.join(total, F.lit(True))
    return joined.select(*by, "cls", F.round(f1, 6).alias("f1"), F.col("t").alias("support"),
                         F.round(F.col("hits") / F.col("n_all"), 6).alias("accuracy"))


def cross_validate(df: DataFrame, k: int = 5, **forest: int) -> DataFrame:
    """Fold, accuracy and per-class F1 of ``k`` fits, each on the other folds and measured on its own."""
    data = write_table(folds(df, k), "folds")
    scored = None
    for i in range(k):
        model = train(data.filter(F.col("fold") != i), **forest)
        part = predict(model, data.filter(F.col("fold") == i)).select("fold", "label", "cls")
        scored = part if scored is None else scored.unionByName(part)
    return metrics(confusion(scored, "label", "cls", ("fold",)), ("fold",))


def fold_summary(scored: DataFrame) -> DataFrame:
    """Number of folds, mean accuracy and its deviation over them, from :func:`cross_validate`."""
    one = scored.groupBy("fold").agg(F.max("accuracy").alias("accuracy"))
    return one.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("deviation"))


def class_distribution(codes: DataFrame, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Count and share of all five classes, absent ones as 0."""
    counts = codes.groupBy(*by).agg(*[F.sum((F.col("cls") == i).cast("long")).alias(f"c{i}") for i in range(N_CLASSES)], F.count(F.lit(1)).alias("_n"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(f"c{i}").alias("n")) for i in range(N_CLASSES)]))
    return counts.select(*by, "_n", rows.alias("x")).select(*by, "x.cls", "x.n", (F.col("x.n") / F.col("_n")).alias("share"))
