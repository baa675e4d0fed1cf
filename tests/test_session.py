from lumbre import session


def test_lineage_is_cut_in_the_folder_the_session_names(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert shared in session.checkpoint_dir(spark)
    df = session.cut_lineage(spark.range(10).filter("id > 3"))
    assert df.count() == 6 and "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_workers_find_the_package(spark):
    session.prepare(spark)
    session.prepare(spark)
    path = spark.sparkContext.environment["PYTHONPATH"].split(":")
    assert len(set(path)) == len(path)
