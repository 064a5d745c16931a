from veilspark.llm import queries


def test_oracles_are_sql_of_registered_queries():
    assert all(isinstance(q, str) for q in queries.ORACLES.values()) and set(queries.ORACLES) <= set(queries.QUERIES)
