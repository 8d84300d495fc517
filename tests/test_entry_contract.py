"""The driver may call queries()/oracle_sql() before any session exists."""

import subprocess
import sys

from conftest import ROOT


def test_contract_needs_no_session_at_import():
    code = ("import sys; sys.path.insert(0, %r)\n"
            "import __spark_entry__ as E\n"
            "q, o = E.queries(), E.oracle_sql()\n"
            "from auric.plans.registry import load_all\n"
            "assert set(load_all()) <= set(o) <= set(q)\n"
            "from pyspark import SparkContext\n"
            "assert SparkContext._active_spark_context is None\n"
            "print(len(load_all()))" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.strip().splitlines()[-1]) == 97
