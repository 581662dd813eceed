import time

from tessera.llm import common


def test_caches_are_emptied_after_a_pause_but_not_between_tasks(monkeypatch):
    monkeypatch.setattr(common, "LINGER", 0.3)
    emptied = []
    for _ in range(3):
        assert list(common.emptied(iter([1, 2]), lambda: emptied.append(1))) == [1, 2]
    assert not emptied
    running = common.emptied(iter([1, 2]), lambda: emptied.append(2))
    assert next(running) == 1
    time.sleep(0.6)
    assert not emptied  # a task is running
    running.close()
    time.sleep(0.6)
    assert sorted(emptied) == [1, 1, 1, 2]


def test_scratch_keeps_what_it_is_told_to(spark):
    with common.scratch(spark) as keep:
        one = common.materialize(spark.range(3).toDF("a"), "one")
        two = keep(common.materialize(one.where("a > 0"), "two"))
    assert two.count() == 2
    path = one._tessera_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    files = lambda: {f.getName() for f in _each(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(common._CLEANUP)
    kept = spark.range(1000).repartition(3, "id")
    assert kept.count() == 1000 and files() - before  # what is not materialized keeps Spark's own way
    others = files()
    out = common.materialize(spark.range(1000).repartition(4, "id").groupBy("id").count(), "dealt")
    for _ in range(50):  # files are removed in the background
        if not files() - others:
            break
        time.sleep(0.1)
    assert not files() - others and out.count() == 1000
    assert spark.conf.get(common._CLEANUP) == setting


def _each(scala_seq):
    it = scala_seq.iterator()
    while it.hasNext():
        yield it.next()
