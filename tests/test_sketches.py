"""Sketches per part: merging, bounds, what they can and cannot see."""

from pyspark.sql import functions as F

from veladura.operators.sketches import add_parts, bound, convergence_bounds, merged, overlaps, sketch_parts

PAIRS = {"v": "p"}


def rows(spark, n, parts=5):
    """Each value three times, in different parts, and a hot one in a third of the rows."""
    ids = spark.range(3 * n)
    value = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % n).cast("string")))
    return ids.select((F.col("id") % parts).alias("day"), value.alias("v")).withColumn("p", F.md5("v"))


def one(df):
    return df.collect()[0]


def test_exact_below_the_size_in_any_order(spark, tmp_path):
    data = rows(spark, 1000)
    for day in (3, 0, 4, 1, 2):
        add_parts(data.filter(F.col("day") == day), PAIRS, "day", f"{tmp_path}/s")
    parts = spark.read.parquet(f"{tmp_path}/s")
    exact = data.select("v").distinct().count()
    got, whole = one(convergence_bounds(parts)), one(convergence_bounds(sketch_parts(data.withColumn("day", F.lit(0)), PAIRS, "day")))
    assert (got.n_parts, got.n_values, got.n_raw, got.n_pairs) == (5, 3000, exact, exact)
    assert got[2:] == whole[2:] and got.deterministic and got.injective
    # what the whole holds is in the merged parts: merging both adds nothing
    both = merged(parts).unionByName(merged(sketch_parts(data.withColumn("day", F.lit(0)), PAIRS, "day"))).drop("n_parts")
    assert one(merged(both.withColumn("n_parts", F.lit(1)))).n_values == 6000
    assert one(convergence_bounds(both)).n_raw == exact


def test_within_the_bound_beyond_it(spark):
    data = rows(spark, 20_000)
    exact = data.select("v").distinct().count()
    got = one(convergence_bounds(sketch_parts(data, PAIRS, "day", 10), 10))
    limit = one(spark.range(1).select(bound(F.lit(exact), 10)))[0]
    assert 0 < limit < 0.1 * exact
    assert all(abs(n - exact) <= limit for n in (got.n_raw, got.n_protected, got.n_pairs))


def test_violations_nulls_and_blanks(spark):
    data = rows(spark, 500)
    salted = data.withColumn("p", F.concat("p", F.col("day").cast("string")))
    assert not one(convergence_bounds(sketch_parts(salted, PAIRS, "day"))).deterministic
    short = data.withColumn("p", F.left("p", F.lit(1)))
    got = one(convergence_bounds(sketch_parts(short, PAIRS, "day")))
    assert got.deterministic and not got.injective
    odd = spark.createDataFrame([("x", None, 1), ("x", "", 1), (None, "q", 1), (" ", "q", 1), ("y", "z", None)], "v string, p string, day int")
    got = one(convergence_bounds(sketch_parts(odd, PAIRS, "day")))
    assert (got.n_values, got.n_raw, got.n_protected, got.n_pairs, got.deterministic) == (3, 2, 2, 3, False)
    assert convergence_bounds(sketch_parts(odd.limit(0), PAIRS, "day")).isEmpty()


def test_overlap_of_new_and_held(spark):
    make = lambda a, b: sketch_parts(spark.range(a, b).selectExpr("0 AS day", "string(id) AS v", "md5(string(id)) AS p"), PAIRS, "day")
    assert tuple(one(overlaps(make(50, 150), make(0, 100)))) == ("v", 50, 50)
    assert tuple(one(overlaps(make(0, 10), make(0, 0)))) == ("v", 10, 0)
