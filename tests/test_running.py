import random

from pyspark.sql import functions as F

from gridloom.functions.ranges import interval_join
from gridloom.functions.running import running


def test_running_matches_a_plain_loop_on_a_skewed_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else f"k{rnd.randint(0, 3)}", s, rnd.choice([None, 1, 2, 5])) for s in rnd.sample(range(2000), 700)]
    df = spark.createDataFrame(rows, "k string, s long, v int").repartition(5)
    out = running(
        df, ["k"], "s",
        {"sum_": ("sum", F.col("v")), "max_": ("max", F.when(F.col("v") == 5, F.col("s")))},
        {"min_": ("min", F.when(F.col("v") == 1, F.col("s"))), "rest": ("sum", F.lit(1))},
        block=37,
    ).collect()
    assert len(out) == len(rows)
    for r in out:
        same = [x for x in rows if x[0] == r.k]
        upto, onward = [x for x in same if x[1] <= r.s], [x for x in same if x[1] >= r.s]
        assert r.sum_ == sum(x[2] or 0 for x in upto)
        assert r.max_ == max((x[1] for x in upto if x[2] == 5), default=None)
        assert r.min_ == min((x[1] for x in onward if x[2] == 1), default=None)
        assert r.rest == len(onward)


def test_interval_join_matches_brute_force(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.randint(-50, 300)) for i in range(80)]
    ivs = [(j, a, a + rnd.randint(0, 90)) for j in range(60) for a in [rnd.randint(-40, 280)]]
    p, i = spark.createDataFrame(pts, "p int, t long"), spark.createDataFrame(ivs, "i int, a long, b long")
    got = {(r.p, r.i) for r in interval_join(p, i, F.col("t"), F.col("a"), F.col("b"), 13).collect()}
    assert got == {(x, j) for x, t in pts for j, a, b in ivs if a <= t < b}
