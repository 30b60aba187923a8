import random

from pyspark.sql import functions as F

from marlstone import plans
from marlstone.plans import carry_forward, hash_sample, running_sum


def rows(n=400):
    rng = random.Random(5)
    return [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice([None, f"v{i}"]), rng.randrange(3)) for i in range(n)]


def test_running_sum_and_carry(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, i int, v string, x int").repartition(3)
    sums, last, want = {}, {}, {}
    for g, i, v, x in data:
        sums[g] = sums.get(g, 0) + x
        last[g] = v if v is not None else last.get(g)
        want[i] = (sums[g], last[g])
    a = {r["i"]: r["s"] for r in running_sum(df, ["g"], ["i"], F.col("x"), "s").collect()}
    b = {r["i"]: r["c"] for r in carry_forward(df, ["g"], ["i"], "v", "c").collect()}
    assert {i: (a[i], b[i]) for i in want} == want and len(a) == len(b) == len(data)
    assert running_sum(df.limit(0), ["g"], ["i"], F.col("x"), "s").count() == 0


def test_hash_sample_is_bounded_and_stable(spark):
    df = spark.range(20_000)
    a = {r[0] for r in hash_sample(df, 500, ["id"]).collect()}
    assert a == {r[0] for r in hash_sample(df.repartition(7), 500, ["id"]).collect()} and 350 < len(a) < 650
    assert hash_sample(df.limit(10), 500, ["id"]).count() == 10


def test_views(spark, sf_dir):
    from marlstone.operators.retrieval_queries import bm25_topk
    from marlstone.plans import register_views

    register_views(spark, sf_dir, ["documents"], {"bm25_topk": bm25_topk})
    n = spark.sql("SELECT count(*) FROM bm25_topk b JOIN documents d USING (doc_id) WHERE b.rank = 0").first()[0]
    assert n == bm25_topk(spark, sf_dir).filter("rank = 0").count()


def test_kept_tables_and_released_stages(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t")).filter("id > 1")
    key = plans.content_key(read())
    assert key == plans.content_key(read()) != plans.content_key(read().filter("id > 2")) and plans.content_key(spark.range(3)) is None
    first = plans.kept(read(), "rows", key)
    assert plans.kept(read().limit(0), "rows", key).count() == first.count() == 3  # what is there is read, not written again
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert plans.content_key(read()) != key
    stage = plans.staged(spark.range(4))
    assert stage.count() == 4 and plans.release(spark) >= 1 and plans.release(spark) == 0 and first.count() == 3


def test_samples_of_repeated_ids_are_refused(spark):
    df = spark.range(1000).selectExpr("id % 2 as id")
    try:
        got = plans.hash_sample(df, 100, ["id"]).count()
        assert got == 0  # neither of the two values was drawn
    except ValueError:
        pass
    assert 50 <= plans.hash_sample(spark.range(10_000), 100, ["id"]).count() <= 200
