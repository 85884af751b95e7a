import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.helpers import components
from txrisk.llm.components import connected_components


def _run(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    return {r["node"]: r["label"] for r in connected_components(df).collect()}


def test_chain_hub_and_islands(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)]
    links += [(-5, 3), (3, -5), (3, 3), (4, 4)]
    random.Random(1).shuffle(links)
    want = components({x for e in links for x in e if e[0] != e[1]},
                      [e for e in links if e[0] != e[1]])
    assert _run(spark, links) == want


def test_empty_and_null_ends(spark):
    assert _run(spark, [(1, None), (None, None)]) == {}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_random_graphs(spark, links):
    real = [e for e in links if e[0] != e[1]]
    assert _run(spark, links) == components({x for e in real for x in e}, real)
