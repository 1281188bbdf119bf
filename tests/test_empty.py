"""Every core query on empty tables: it runs and keeps its columns."""

import glob
import os

import pytest

from webspark import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for p in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(p).limit(0).coalesce(1).write.parquet(str(root / os.path.basename(p)))
    return str(root)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty(spark, empty, name):
    df = plans.QUERIES[name](spark, empty)
    # These two read written examples, not tables.
    assert df.columns and (len(df.take(5)) <= 4 or name in ("resolve_dots", "serp_results"))
