from pyspark.sql import functions as F

from quern.ordering import with_place


def test_places_are_whole_and_in_order(spark, rows):
    got = with_place(spark.range(1000).repartition(7).withColumn("k", -F.col("id")), "k").collect()
    assert sorted(r.place for r in got) == list(range(1, 1001)) and all(r.place == 1000 - r.id for r in got)
    assert sorted(r.place for r in with_place(rows("a int", (1,), (1,), (None,)), "a").collect()) == [1, 2, 3]
    assert with_place(rows("a int"), "a").count() == 0
