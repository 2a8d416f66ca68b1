"""Registered queries against their SQL twins on the smallest tables.

One query per kind of work, or all of them with ``ALL_TWINS=1``.
"""

import os

import duckdb
import pytest

from secretsift.catalog.oracles import ORACLES
from secretsift.catalog.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(
            f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


SOME = [
    "q01_seed_domains", "q08_archive_filter", "q09_response_normalise", "q11_subdomain_union", "q13_registered_domain",
    "q17_internal_links_int", "q22_network_resources", "q24_dedup_last", "q28_tier_resource",
    "q29_tiered_limit_ranges", "q30_priority_distribution", "q34_findings_auth", "q37_report_written",
    "q38_flagship", "q39_incremental_scan",
]


@pytest.mark.parametrize("name", QUERIES if os.environ.get("ALL_TWINS") else SOME)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in places) for row in cursor.fetchall()), key=repr)
    assert got == want
