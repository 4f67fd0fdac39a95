"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from compare import oracle, rows
from seqloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns, data = oracle(SF, registry.SQL[name])
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, data)


def test_core_does_not_need_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "seqloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
