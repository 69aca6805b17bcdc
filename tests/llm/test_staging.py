import pyarrow as pa
from pyspark.sql import functions as F

from quillflow.llm.staging import delete, forget, shared_dir, small_batches, stage


def test_batches_are_bounded_by_bytes(spark):
    small_batches(spark, 1000, "1m")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    long = spark.range(20, numPartitions=1).select(F.repeat(F.lit("x"), 500_000).alias("t"))
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) <= 4


def test_staged_tables_are_read_again_and_deleted(spark):
    df = stage(spark.range(5).withColumn("x", F.rand()), "t")
    assert df.collect() == df.collect() and shared_dir(spark) in df.inputFiles()[0]
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    forget(df)
    delete(spark, folder)  # it is gone already
    assert stage(spark.range(0), "t").count() == 0


def test_lower_bounds_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    small_batches(spark)
    assert spark.conf.get(name) == "7"
    spark.conf.set(name, "0")  # no bound
    small_batches(spark)
    assert spark.conf.get(name) == "1000"
    spark.conf.set(name, before)
