import random

from pyspark.sql import functions as F

from tidemill.functions.timestamps import instant_us
from tidemill.operators.gap_tree import cut, gap_tree


def brute(points, gap):
    out, by = [], {}
    for e, t in points:
        if e is not None and t is not None:
            by.setdefault(str(e), []).append(t)
    for e, ts in by.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:]:
            if t - run[-1] > gap:
                out.append((e, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        out.append((e, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out)


def test_cut_equals_brute_force_for_many_settings(spark):
    rng = random.Random(7)
    points = [(e, rng.choice([rng.randrange(500), rng.randrange(0, 5000, 10)])) for e in "abcd" for _ in range(150)]
    points += [("hot", 3 * i) for i in range(1000)] + [("one", 5), (None, 4), ("a", None)]
    df = spark.createDataFrame([(e, t, 1) for e, t in points], "e string, t bigint, n int")
    tree = gap_tree(df, "e", "t", levels_us=(40, 400)).cache()
    for gap in (0, 1, 2, 3, 5, 9, 10, 30, 100, 10_000):
        assert sorted(tuple(r) for r in cut(tree, gap).collect()) == brute(points, gap), gap
    assert tree.where("gap_us >= parent_gap_us").count() == 0


def test_empty_table_gives_no_session(spark):
    df = spark.createDataFrame([], "e string, t bigint")
    assert cut(gap_tree(df, "e", "t"), 5).count() == 0


def test_timestamps_of_all_writers(spark):
    cases = {
        "1970-01-01T00:00:01Z": 1_000_000,
        "1970-01-01 00:00:01": 1_000_000,
        "1970-01-01T02:00:00.5+02:00": 500_000,
        "1970-01-01T05:30:00.123456789+0530": 123_456,
        "1969-12-31T20:00:00-04:00": 0,
        "1548211367000": 1_548_211_367_000_000,
        "2019-02-30T00:00:00Z": None,
        "0000-00-00T00:00:00Z": None,
        "yesterday": None,
        "": None,
        "--": None,
        "2019": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", instant_us(F.col("t")).alias("us"))
    assert {r.t: r.us for r in df.collect()} == cases
