import time

from oddsmith.llm.shared import written


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()))
    return {x for x in names if x.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(10_000).repartition(7, "id")
    table = written(df.groupBy((df.id % 10).alias("k")).count())
    # Blocks are removed in the background.
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, table.collect())) == [(k, 1000) for k in range(10)]
