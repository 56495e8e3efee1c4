"""Every query against its SQL, at the smallest scale."""

import collections

import pytest

from tests.compare import connect, rows_of_spark, rows_of_sql
from tokensieve.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    names, got = rows_of_spark(QUERIES[name](spark, sf_dir))
    want_names, want = rows_of_sql(con, ORACLES[name])
    assert names == want_names
    assert got == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_rouge_l(spark, sf_dir):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    want = {}
    for c, rows in turns.items():
        rows.sort()
        for (t, _, p), (_, _, q) in zip(rows, rows[1:]):
            a, b = p.lower().split(), q.lower().split()
            n = lcs(a, b)
            want[c, t] = (n / max(len(a), 1), n / max(len(b), 1))
    got = {(r.conv_id, r.turn): r for r in QUERIES["rouge_l"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for k, (p, r) in want.items():
        assert abs(got[k].precision - p) < 1e-6 and abs(got[k].recall - r) < 1e-6


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
