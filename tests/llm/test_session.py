from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def test_queries_leave_the_session_as_it_was(spark):
    """In any order, every query gives the same rows and no setting changes."""
    before = dict(spark.conf.getAll)
    first = {name: query(spark, SF).count() for name, query in queries.QUERIES.items()}
    again = {name: query(spark, SF).count() for name, query in reversed(queries.QUERIES.items())}
    assert first == again and dict(spark.conf.getAll) == before
