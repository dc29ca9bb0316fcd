import numpy as np
from pyspark.sql import functions as F

from selenogrid.operators import classify


def _classes(spark, n, tasks):
    """Rows of three classes that overlap a little, with eight features."""
    x = [((F.hash("id", F.lit(i)) % 1000) / 1000.0).alias(c) for i, c in enumerate(classify.FEATURES)]
    label = F.when(F.col("elev_n") > 0.4, 2).when(F.col("slope_n") + F.col("rough_n") > 0.3, 1).otherwise(0)
    return spark.range(0, n, 1, tasks).select("id", *x).withColumn("label", label)


def test_forest_batches_meet_the_rows_in_as_few_tasks_as_hold_them(spark, monkeypatch):
    df = _classes(spark, 600, 6)
    track = spark.sparkContext.statusTracker()
    for rows, tasks in ((classify.TASK_ROWS, 1), (250, 3)):
        monkeypatch.setattr(classify, "TASK_ROWS", rows)
        group = f"forest-{tasks}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            model = classify.train(df, trees=12, depth=4)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds]
        assert {s.numTasks for s in stages if s and "RandomForest" in s.name} == {tasks}
        assert [b.getNumTrees for b in classify.batches_of(model)] == [10, 2]


def test_all_trees_of_all_batches_vote(spark, tmp_path):
    df = _classes(spark, 900, 2)
    model = classify.train(df, trees=23, depth=5)
    trees = [t for b in classify.batches_of(model) for t in b.trees]
    assert len(trees) == 23 and len({t.toDebugString.split("\n", 1)[1] for t in trees}) > 20
    classify.save(model, str(tmp_path / "forest"))
    loaded = classify.predict(classify.load(spark, str(tmp_path / "forest")), df).select("id", "cls").collect()
    got = dict(classify.predict(model, df).select("id", "cls").collect())
    assert got == dict(loaded)
    votes = {}
    held = model.stages[0].transform(df)
    for t in trees:
        for r in t.transform(held).collect():
            votes[r.id] = votes.get(r.id, 0.0) + r[-1].toArray() / r[-1].toArray().sum()
    clear = {i: v for i, v in votes.items() if np.sort(v)[-1] - np.sort(v)[-2] > 1e-9}
    assert len(clear) > 890 and all(got[i] == int(v.argmax()) for i, v in clear.items())
    shares = classify.importances(spark, model, top=8).collect()
    want = sum(t.featureImportances.toArray() for t in trees) / 23
    assert abs(sum(r.importance for r in shares) - 1.0) < 1e-9
    assert all(abs(r.importance - want[classify.FEATURES.index(r.feature)]) < 1e-9 for r in shares)
