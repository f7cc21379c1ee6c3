import pytest

from quillon.plans import ORACLES, QUERIES, vector_queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, matches_sql):
    matches_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("measure", [vector_queries.graph_recall, vector_queries.probed_graph_recall, vector_queries.quantized_recall, QUERIES["eval_recall_at_k"]])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, measure, sf):
    """Nine tenths of the true neighbours at least, by brute force over every vector."""
    row = measure(spark, f"/root/testdata/{sf}").first()
    print(sf, measure.__name__, row["recall"])
    assert row["recall"] >= 0.9
