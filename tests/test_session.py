from types import SimpleNamespace

from quillrank.session import bucket_count, index_buckets, input_bytes, shared_dir


def session(settings):
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name, default))
    context = SimpleNamespace(applicationId="app", getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_is_the_configured_one_or_below_the_warehouse():
    both = {"spark.checkpoint.dir": "hdfs:///shared/", "spark.sql.warehouse.dir": "hdfs:///warehouse"}
    assert shared_dir(session(both)) == "hdfs:///shared"
    assert shared_dir(session({"spark.sql.warehouse.dir": "hdfs:///warehouse/"})) == "hdfs:///warehouse/quillrank_shared"


def test_bucket_count(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 1000)
    assert input_bytes(spark, f"file:{tmp_path}") == 1000
    assert bucket_count(spark, 1000) == spark.sparkContext.defaultParallelism
    assert bucket_count(spark, 100 << 30) == 400
    assert bucket_count(spark, 1 << 60) == 100_000


def test_buckets_of_an_index_do_not_grow(spark):
    for positions, most in ((False, 8 << 20), (True, 2 << 20)):
        for size in (1 << 30, 6 << 30):
            assert size / index_buckets(spark, size, positions) <= most
