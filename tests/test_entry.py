import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    """Modules build no expression before there is a session."""
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")})
    assert done.returncode == 0, done.stderr[-2000:]


def test_every_order_gets_an_id(spark):
    import __spark_entry__

    path = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["order_ids"](spark, path).collect()
    assert sorted(r["o_orderkey"] for r in rows) == sorted(r["o_orderkey"] for r in spark.read.parquet(f"{path}/orders.parquet").collect())
    assert all((r["id_length"], r["valid"], r["n_same"]) == (36, True, 1) for r in rows)
