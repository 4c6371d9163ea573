import __spark_entry__
from corvane.plans import catalogue


def test_every_query_is_registered_and_sql_has_a_query():
    names = set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= names and set(__spark_entry__.oracle_sql()) <= names


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"system", "n_bona", "n_spoof", "eer", "threshold"}
