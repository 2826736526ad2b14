from pyspark.sql import functions as F

from dealscope.operators import groups, profile, ranking


def rows_of(spark):
    return spark.range(0, 9000, 1, 6).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 7 % 1009).cast("double").alias("v")).unionByName(spark.createDataFrame([(None, 1.0), ("9", None)], "k string, v double"))


def most_of_a_task(df):
    return max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_few_groups_stay_where_they_are(spark):
    df = rows_of(spark)
    for out in (profile.ratio_outliers(df, "k", "v", 1.0, 1.0), groups.with_group_median(df, "k", "v"), groups.group_total(df, "k", "v")):
        # a shuffle by the key would put a group's 3,000 rows in one task
        assert out.count() > 8900 and most_of_a_task(out) <= 1600


def test_figures_of_many_groups_meet_rows_by_shuffle(spark):
    df = rows_of(spark)
    stats = df.filter("k is not null").groupBy("k").agg(F.max("v").alias("top"))
    for how in ("inner", "left"):
        few, many = (groups.by_group(df, stats, "k", how, few=n).select("k", "v", "top") for n in (100, 1))
        assert few.count() == (9001 if how == "inner" else 9002) and few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_a_task_ranks_half_a_million_rows_of_a_group_at_most():
    assert ranking.MOST_IN_GROUP <= 500_000
