"""Co-partitioned tables join without moving rows."""

from pyspark.sql import functions as F
from seqloom.layout import KEY, STEP
from seqloom.operators import joins
from seqloom.sources.buckets import exchanges, store_bucketed


def test_no_exchange_between_equal_buckets(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5_000).select((F.col("id") % 7).alias(KEY), F.floor(F.col("id") / 7).alias(STEP), F.col("id").alias("v"))
        mask = rows.filter("v % 3 = 0").select(KEY, STEP, (F.col("v") % 2 == 0).alias("keep"))
        plain = joins.join_mask(rows, mask)
        stored = joins.join_mask(store_bucketed(rows, "bucket_rows", 6, path=str(tmp_path / "a")), store_bucketed(mask, "bucket_mask", 6, path=str(tmp_path / "b")))
        assert exchanges(plain) == 2 and exchanges(stored) == 0
        assert stored.exceptAll(plain.select(*stored.columns)).count() == 0 and stored.count() == plain.count()
        assert exchanges(stored.groupBy(KEY, STEP).count()) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("bucket_rows", "bucket_mask"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
