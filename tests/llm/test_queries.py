import subprocess
import sys

import oracle
import pytest

import __spark_entry__ as entry
from evalspark.llm import queries


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    at = str(oracle.DATA / "sf0.01")
    assert oracle.compare(queries.QUERIES[name](spark, at), queries.SQL[name], oracle.connect(at)) is None


def test_entry_without_the_package():
    code = ("import sys; sys.modules['evalspark.llm'] = None; import __spark_entry__ as e; "
            "assert e.queries() and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
