import os
from datetime import datetime

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    if name in SQL:
        oracle.compare(spark, QUERIES[name], SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_order_lines_that_are_alike_are_all_counted(spark, tmp_path):
    """Lines of one number and day, and lines from before 1970."""
    day = lambda *at: datetime(*at)
    lines = [(1, 3, day(1996, 5, 1)), (1, 3, day(1996, 5, 1)), (2, 1, day(1969, 5, 1)), (2, 2, day(1969, 5, 2)), (3, 1, day(1996, 5, 1)), (3, 2, None), (4, None, day(1996, 5, 1)), (4, None, day(1996, 5, 1))]
    spark.createDataFrame([(i, day(1995, 1, 1)) for i in range(1, 6)], "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert oracle.compare(spark, QUERIES["order_lifecycle_flow"], SQL["order_lifecycle_flow"], str(tmp_path)) == 5


def test_sql_is_of_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_imports_without_the_training_data_operators(tmp_path):
    """The rest works where that subpackage and its pipeline are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(entry.__file__)
    shutil.copytree(f"{root}/ledgerline", f"{tmp_path}/ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and len(s) > 60 and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def test_placement_equals_the_plain_function(spark):
    from ledgerline.operators import dcb
    from ledgerline.sources.event_log import event_log

    got = {r.streamid: r.n for r in QUERIES["dcb_stream_placement"](spark, SF).collect()}
    want = {}
    for r in event_log(spark, SF, False).where("dcbtags is not null").select("dcbtags").collect():
        s = dcb.stream_of(r[0])
        want[s] = want.get(s, 0) + 1
    assert got == want
