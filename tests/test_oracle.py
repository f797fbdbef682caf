"""Every registered query against its SQL oracle on the correctness tables."""

import os

import pytest

from checks import compare, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(compare.norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    ix = [names.index(c) for c in cols]
    want = [tuple(compare.norm(r[i]) for i in ix) for r in cur.fetchall()]
    assert compare.same(got, want) == ""


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
