"""Segmented windows give what one plain window gives, also for one very busy key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from careline.functions import segments as S
from careline.operators import turns as O


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds far more than a third of all rows."""
    key = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10)
    base = spark.range(1000).select(key.alias("k"), F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    w = Window.partitionBy("k").orderBy("id")
    return base.withColumn("pos", F.row_number().over(w) - 1).cache()


@pytest.mark.parametrize("size", [3, 10, 1000])
def test_frames(rows, size):
    w = Window.partitionBy("k").orderBy("pos")
    want = rows.select("*", F.lag("v", 2).over(w).alias("a"), F.lead("v").over(w).alias("b"),
                       F.max("v").over(w.rowsBetween(-3, -1)).alias("c"))
    have = S.over_frame(rows, ["k"], "pos", {
        "a": lambda x: F.lag("v", 2).over(x), "b": lambda x: F.lead("v").over(x),
        "c": lambda x: F.max("v").over(x.rowsBetween(-3, -1))}, before=3, after=1, size=size)
    assert want.exceptAll(have).count() == 0 and have.count() == 1000


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_running(rows, size):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    have = S.running(rows, ["k"], ["pos"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))},
                     S.segment("pos", size))
    assert want.exceptAll(have).count() == 0 and have.count() == 1000


@pytest.mark.parametrize("size", [5, 50, 5000])
def test_positions_of_sparse_order(rows, size):
    have = S.dense_position(rows, ["k"], ["id"], S.segment("id", size), "p")
    assert have.filter("p <> pos").count() == 0


def test_frame_must_fit(rows):
    with pytest.raises(ValueError):
        S.over_frame(rows, ["k"], "pos", {}, before=6, size=3)


@pytest.mark.parametrize("size", [2, 1000])
def test_merge_same_role_over_segments(spark, size):
    said = "uuaauuuaxaauu"
    data = [(1, i, {"u": "user", "a": "assistant", "x": "user"}[c], "no" if c == "x" else f"text{i}")
            for i, c in enumerate(said)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = O.merge_same_role(df, size=size).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in out] == [
        (0, "user", "text0 text1"), (1, "assistant", "text2 text3"), (2, "user", "text4 text5 text6"),
        (3, "assistant", "text7 text9 text10"), (4, "user", "text11 text12")]


@pytest.mark.parametrize("n,width,want", [(2, 4, [-1]), (3, 4, [-1, 1]), (5, 2, [-1, 1, 2, 3]), (6, 4, [-1, 1, 2, 3, 4])])
def test_augmented_windows(spark, n, width, want):
    pairs = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("p"), F.lit(n).cast("long").alias("n"))
    out = O.augment_windows(pairs, width)
    assert sorted({r.start for r in out.collect()}) == want
    sizes = {r.start: r["count"] for r in out.groupBy("start").count().collect()}
    assert all(sizes[s] == min(s + width, n) - s for s in want if s > 0) and sizes[-1] == n


def test_split_is_exact_and_repeatable(spark):
    ids = spark.range(1003).withColumnRenamed("id", "conv_id")
    a, b = O.train_valid_split(ids, "conv_id", 0.85), O.train_valid_split(ids.repartition(5), "conv_id", 0.85)
    assert a.filter("split = 'train'").count() == int(1003 * 0.85) and a.exceptAll(b).count() == 0
