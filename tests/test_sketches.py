"""Mergeable profile states, texts inside texts, and frequent items against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clearwell.operators import substrings
from clearwell.operators.profile import profile
from clearwell.operators.sketches import merge_states, profile_state, state_profile, store_state, stored_states


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, rng.randrange(10**12)]), rng.choice([None, float("nan"), rng.gauss(1e9, 1)]), rng.choice(["a", None, f"t{rng.randrange(900)}"]),
             f"2024-0{rng.randrange(1, 10)}-1{rng.randrange(10)}", rng.random() < 0.5) for _ in range(n)]


SCHEMA = "i long, x double, t string, d string, b boolean"


def merged_profile(parts):
    states = profile_state(parts[0])
    for p in parts[1:]:
        states = states.union(profile_state(p))
    return {r.column_name: r for r in state_profile(merge_states(states)).collect()}


def test_merged_states_equal_the_profile_of_the_union(spark):
    data = rows(1, 6000)
    parts = [spark.createDataFrame(data[a:b], SCHEMA) for a, b in ((0, 1), (1, 900), (900, 900), (900, 6000))]
    got = merged_profile(parts)
    want = {r.column_name: r for r in profile(spark.createDataFrame(data, SCHEMA), exact=True).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert (g.ordinal, g.data_type, g.nullable, g.row_count, g.null_count, g.min, g.max) == (
            w.ordinal, w.data_type, w.nullable, w.row_count, w.null_count, w.min, w.max)
        assert abs(g.distinct_values - w.distinct_values) <= max(1, 0.04 * w.distinct_values)
        if w.mean is None:
            assert g.mean is None and g.median is None
        else:
            assert g.mean == pytest.approx(w.mean, rel=1e-12) and g.stddev == pytest.approx(w.stddev, rel=1e-6)
            values = sorted(v for v in (r[w.ordinal] for r in data) if v is not None and v == v)
            for p, q in ((0.25, g.q1), (0.5, g.median), (0.75, g.q3)):
                assert abs(sum(v <= q for v in values) / len(values) - p) < 0.02


def test_states_of_empty_and_mixed_batches(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = merged_profile([empty, empty])
    assert got["x"].row_count == 0 and got["x"].median is None and got["t"].distinct_values == 0
    nulls = spark.createDataFrame([(None,) * 5], SCHEMA)
    got = merged_profile([nulls, spark.createDataFrame(rows(2, 50), SCHEMA)])
    assert got["d"].data_type == "datetime" and got["d"].null_count == 1
    numbers = [spark.createDataFrame([(1,)], "v long"), spark.createDataFrame([(0.5,)], "v double"), spark.createDataFrame([("1",)], "v string")]
    assert merged_profile(numbers[:2])["v"].data_type == "float" and merged_profile(numbers[:2])["v"].mean == 0.75
    both = merged_profile(numbers)["v"]
    assert (both.data_type, both.mean, both.row_count) == ("string", None, 3)


def test_states_are_kept_by_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(3, 300), SCHEMA)
    for batch, part in ((0, df.limit(100)), (1, df), (1, df.where("false")), (2, df.where("i is null"))):
        store_state(part, str(tmp_path), "t", batch)
    kept = stored_states(spark, str(tmp_path), "t")
    got = {r.column_name: r for r in state_profile(merge_states(kept.drop("batch_id"))).collect()}
    assert got["i"].row_count == 100 + df.where("i is null").count()
    by_batch = merge_states(kept, ("batch_id",)).where("column_name = 't'").orderBy("batch_id").collect()
    assert [r.row_count for r in by_batch][:2] == [100, 0]


@pytest.mark.parametrize("sizes", [None, (40, 60)])
def test_parts_of_equals_brute_force(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(substrings, "PART_BYTES", sizes[0])
        monkeypatch.setattr(substrings, "WHOLE_BYTES", sizes[1])
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    parts = sorted({word(rng.randrange(7)) for _ in range(40)} | {"", "a" * 300})
    wholes = sorted({word(rng.randrange(30)) for _ in range(50)} | {"", "é"})
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    names = {r[0]: r[1] for r in frame(sorted({*parts, *wholes})).select(F.md5("text"), "text").collect()}
    got = sorted((names[r.part], names[r.whole]) for r in substrings.parts_of(frame(parts), frame(wholes)).collect())
    assert got == sorted((p, w) for p in parts for w in wholes if p in w)
    assert substrings.parts_of(frame([]), frame(wholes)).count() == 0 and substrings.parts_of(frame(parts), frame([])).count() == 0


def test_a_hundred_thousand_phrases_with_a_shared_opening(spark):
    phrases = spark.range(100_000).select(F.concat(F.lit("production line stopped at station "), F.format_string("%06d", "id")).alias("text"))
    wholes = spark.range(2_000).select(F.concat(F.lit("report: production line stopped at station "), F.format_string("%06d", F.col("id") * 7), F.lit("; next")).alias("text"))
    found = substrings.parts_of(phrases, wholes).join(phrases.select(F.md5("text").alias("part"), "text"), "part")
    assert found.count() == 2_000


@pytest.mark.parametrize("limit", [512, 8, 1])
def test_most_frequent_equals_brute_force(spark, limit):
    """Columns with a hot value, with ties, of distinct values, of nulls, and one where the best value is just below the bound."""
    from collections import Counter

    from clearwell.operators.frequent import most_frequent

    rng = random.Random(limit)
    n = 4000
    data = [(rng.choice(["hot", f"v{rng.randrange(300)}", None]), f"d{i:05d}", ["b", "a"][i % 2], None, f"x{rng.randrange(12) ** 2 % 7}",
             f"n{i // 2}" if i else "n1") for i in range(n)]
    df = spark.createDataFrame(data, "a string, b string, c string, d string, `e.f` string, g string").repartition(7)
    got = most_frequent(df, df.columns, limit)
    for i, c in enumerate(df.columns):
        counts = Counter(r[i] for r in data if r[i] is not None)
        want = min(((-k, v) for v, k in counts.items()), default=None)
        assert got[c] == ((want[1], -want[0]) if want else None)


def test_most_frequent_deals_no_cells_by_a_frequent_value(spark, monkeypatch):
    """Four values fill the column: the recount must not sort each value's cells in one task."""
    from clearwell.operators.frequent import most_frequent

    plans = []
    collect = type(spark.range(1)).collect

    def seen(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(spark.range(1)), "collect", seen)
    df = spark.range(20000).select(F.concat(F.lit("p"), (F.col("id") * F.col("id") % 7).cast("string")).alias("p"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with a table that is estimated larger
    try:
        assert most_frequent(df, ["p"]) == {"p": ("p1", 5714)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and not any("SortMergeJoin" in p for p in plans)


def test_modes_of_fifty_columns_in_few_jobs(spark):
    from clearwell.operators.repair import column_modes

    df = spark.range(5000).select(*[F.when(F.col("id") % (i + 2) != 0, F.concat(F.lit("w"), (F.col("id") % (i + 3)).cast("string"))).alias(f"c{i}") for i in range(49)],
                                  F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").alias("day"), (F.col("id") % 3 == 0).alias("flag"), F.expr("timestamp_seconds(id % 4)").alias("at"))
    want = {}
    for c in df.columns:
        best = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count().orderBy(F.desc("count"), "v").first() if c in ("c0", "c7", "c48", "day", "flag", "at") else None
        want[c] = best.v if best else None
    sc = spark.sparkContext
    sc.setJobGroup("modes", "modes")
    got = column_modes(df, df.columns)
    jobs = len(sc.statusTracker().getJobIdsForGroup("modes"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(got[c] == v for c, v in want.items() if v is not None) and jobs <= 16


def test_clamp_keeps_whole_numbers(spark):
    from clearwell.operators.repair import Bounds, clamp_outliers

    df = spark.createDataFrame([(9007199254740993, 5, 1.5), (-3, 900, None), (None, -7, 9.5), (9223372036854775807, 7, -1.0)], "a long, b int, c double")
    got = clamp_outliers(df, {"a": Bounds(-2.5, 9.1e15), "b": Bounds(4.2, 7.9), "c": Bounds(0.25, 2.0)})
    assert got.dtypes == df.dtypes
    assert sorted(got.collect(), key=repr) == sorted([(9007199254740993, 5, 1.5), (-2, 7, None), (None, 5, 2.0), (9100000000000000, 7, 0.25)], key=repr)
    narrow = clamp_outliers(df.select("b"), {"b": Bounds(5.2, 5.8)})
    assert {r.b for r in narrow.collect()} <= {5, 6}
