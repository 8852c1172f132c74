import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "n_pages"]
    assert df.count() > 0


def test_every_key_has_oracle_or_is_declared_non_sql():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {k for k in set(q) - set(o) if k != "pipeline" and not k.startswith("op")} == set()


def test_flagship_and_fold_keys_match_oracle_at_smallest_sf(spark):
    con = duck(SF)
    q, o = E.queries(), E.oracle_sql()
    for key in ["extract_categories", "category_counts", "ledger_purchase", "stream_pack_bytes", "category_descendants"]:
        res = compare(spark, key, q[key], o[key], SF, con)
        assert res["ok"], res


@pytest.mark.parametrize("left", ["nothing", "an empty folder"])
def test_the_other_queries_work_without_the_removable_part(scratch, left):
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "pagelake"), os.path.join(scratch, "pagelake"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), scratch)
    if left == "an empty folder":
        os.makedirs(os.path.join(scratch, "pagelake", "llm", "__pycache__"))
        with open(os.path.join(scratch, "corpus_pipeline.py"), "w", encoding="utf-8") as fh:
            fh.write("from pagelake.llm import disclosure\n")
    code = "import __spark_entry__ as E; assert not [k for k in E.queries() if k.startswith('op')]; print(len(E.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=scratch, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 70
