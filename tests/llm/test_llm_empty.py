"""Every text operator's query on empty tables: it runs and gives no rows of records."""

import glob
import os

import pytest

from webspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty-llm")
    for p in glob.glob(f"{DATA}/*.parquet"):
        df = spark.read.parquet(p)
        # Names and targets are parameters; they stay.
        keep = os.path.basename(p) in ("name_parts.parquet", "source_targets.parquet")
        (df if keep else df.limit(0)).coalesce(1).write.parquet(str(root / os.path.basename(p)))
    return str(root)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert not rows or (name == "p9_shares" and all(r.tokens == 0 and r.reached_share == 0 for r in rows))
