import os

from pyspark.sql import functions as F

from pricebench import session


def stored(spark):
    place = f"{session.checkpoint_dir(spark)}/pricebench"
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    kept, before = spark.conf.get(session.SHUFFLE_CLEANUP_KEY), shuffle_files(spark)
    table = session.cut_lineage(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k"))
    assert not shuffle_files(spark) - before
    assert table.count() == 1000 and spark.conf.get(session.SHUFFLE_CLEANUP_KEY) == kept


def test_only_the_result_of_several_steps_stays(spark):
    before = stored(spark)

    def build():
        inner = session.only_result(spark, lambda: session.cut_lineage(spark.range(10)).where("id < 5"))
        return session.cut_lineage(inner).where("id > 2").unionByName(inner.where("id = 0"))

    made = session.only_result(spark, build)
    assert len(stored(spark) - before) == 2  # the inner result may be used again
    assert sorted(r.id for r in made.collect()) == [0, 3, 4]
    try:
        with session.scratch(spark):
            session.cut_lineage(spark.range(3))
            raise KeyError
    except KeyError:
        pass
    assert len(stored(spark) - before) == 2
    session.cut_lineage(spark.range(3))  # outside, tables stay
    assert len(stored(spark) - before) == 3
