import __spark_entry__ as entry


def test_the_flagship_query(spark):
    assert entry.entry(spark).count() >= 1


def test_every_query_with_sql_is_registered():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(callable(q) for q in names.values())


def test_groups_give_as_many_candidates_as_words(spark):
    from pyspark.sql import functions as F

    found = entry.queries()["kbest_multichar"](spark, "/root/testdata/sf0.001")
    assert found.agg(F.max("k")).first()[0] == 4
