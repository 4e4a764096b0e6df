"""Reports over two servers at once equal the reports over each server alone.

Server b holds part of the rows of server a, so keys of the two overlap. All reports are
compared where ALL_SCOPES is set, else those with rankings, windows or rounds.
"""

import inspect
import os

import pytest
from pyspark.sql import functions as F

from registered import QUERIES, over
from servertide.sources.derived import views

SOME = {
    "blocking_tree", "root_blockers", "top_queries", "unused_indexes", "wait_pareto",
}


def scoped(query):
    return isinstance(query, over) and "scope" in inspect.signature(query.report).parameters and "server_name" not in query.parameters.get("scope", ())


NAMES = sorted(n for n, q in QUERIES.items() if scoped(q) and (n in SOME or os.environ.get("ALL_SCOPES")))


@pytest.mark.parametrize("name", NAMES)
def test_servers_stay_apart(spark, sf_dir, name):
    query = QUERIES[name]
    own = list(query.parameters.get("scope", inspect.signature(query.report).parameters["scope"].default))
    whole = views(spark, sf_dir, query.names)
    part = [df.where(F.pmod(F.xxhash64(*df.columns), F.lit(4)) != 0) for df in whole]

    def on_server(df, server):
        return df.withColumn("server_name", F.lit(server))

    both = [on_server(a, "a").unionByName(on_server(b, "b")) for a, b in zip(whole, part)]
    together = query.report(*both, **{**query.parameters, "scope": ["server_name", *own]})
    alone = [
        on_server(query.report(*dfs, **query.parameters), server).select(*together.columns)
        for server, dfs in (("a", whole), ("b", part))
    ]
    expected = [repr(tuple(r)) for df in alone for r in df.collect()]
    assert sorted(repr(tuple(r)) for r in together.collect()) == sorted(expected)
