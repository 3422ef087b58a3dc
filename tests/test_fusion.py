import numpy as np
from pyspark.sql import functions as F

from ledgerlark.operators import similarity as S


def test_fusion_by_tiles(spark, monkeypatch):
    """Any number of rows, in tiles: the pairs and scores of the plain join, with odd vectors too."""
    monkeypatch.setattr(S, "TILE_ROWS", 16)
    monkeypatch.setattr(S, "ANCHOR_ROWS", 2)  # sixteen parts of it are fewer than the rows
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(3).normal(size=(60, 4)))]
    rows += [(60, [0.0, 0.0]), (61, []), (62, None), (63, [None, 1.0, None, 2.0]), (64, [float("nan"), 1.0]), (65, [float("inf"), 1.0]), (66, [1.0, 0.0, -1.0]), (67, rows[0][1]), (67, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "k int, embedding array<double>")
    for least in (0.5, -0.1):
        a, b = df.where("embedding is not null").select(F.col("k").alias("a"), F.col("embedding").alias("v")), df.where("embedding is not null").select(F.col("k").alias("b"), F.col("embedding").alias("w"))
        plain = a.join(b, F.col("a") < F.col("b")).select("a", "b", S.cosine("v", "w").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "a", "b")
        assert [str(tuple(r)) for r in S.fusion_candidates(df, least, "k").collect()] == [str(tuple(r)) for r in plain.collect()]
    assert S.fusion_candidates(df.where("false"), 0.5, "k").count() == 0
