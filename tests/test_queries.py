import __spark_entry__ as entry
import pytest

from .oracle import compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    got, want, _ = compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert got == want
    assert got[1] or name in ("untested_files",), "an empty result tests nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
