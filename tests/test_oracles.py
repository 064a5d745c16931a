import __spark_entry__


def test_oracles_are_sql_of_registered_queries():
    oracles, queries = __spark_entry__.oracle_sql(), __spark_entry__.queries()
    assert all(isinstance(q, str) for q in oracles.values()) and set(oracles) <= set(queries)
