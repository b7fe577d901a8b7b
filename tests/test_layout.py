import os
import pathlib
import re
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for f in (ROOT / "quire").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(?:from|import)\s+quire\.llm", f.read_text(), re.M), f


def test_the_rest_stands_without_llm(tmp_path):
    """With both folders gone the entry still gives the core's queries, and the core's own tests are found and pass."""
    code = "import sys, __spark_entry__ as e; q = e.queries(); assert 'text_search' in q and not any(k[0] == 'p' and k[1].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    for name in ("quire", "tests", "__spark_entry__.py", "README.md", "bench.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    for gone in ("quire/llm", "tests/llm"):
        shutil.rmtree(tmp_path / gone, ignore_errors=True)
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=100)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_passages.py", "tests/test_streaming.py", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, check=True, timeout=600)


def test_the_rest_survives_a_missing_library(tmp_path):
    """An import of the llm subpackage that fails costs its queries only."""
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'text_search' in q and 'p8_containers' not in q"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, timeout=100)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quire import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()
        sparkContext = type("S", (), {"master": "spark://far:7077", "getConf": staticmethod(lambda: Far.conf)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Far())


def test_lookup_by_broadcast_and_by_salt(spark):
    from quire.tables import lookup

    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    want = sorted(((i, 1) if i % 3 else (i, 2) if i == 3 else (i, None) for i in range(60)), key=str)
    for most in (200_000, 0):
        assert sorted(((r["i"], r["v"]) for r in lookup(df, table, ["k"], most_rows=most).collect()), key=str) == want
        assert lookup(df, table, ["k"], "inner", most_rows=most).count() == 41 and lookup(df, table, ["k"], "left_semi", most_rows=most).columns == ["k", "i"]


def test_spread(spark):
    from quire.tables import spread

    one, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=16)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    assert spread(many).rdd.getNumPartitions() == 16


def test_readme_claims_no_survey_id_without_code():
    import re
    from pathlib import Path

    text = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    table, left_out = text[text.index("## Operators of the survey") :].split("Left out:")
    claimed = set(re.findall(r"\b[A-Z]\d\d\b", table))
    for k, a, b in re.findall(r"\b([A-Z])(\d\d)-[A-Z](\d\d)\b", table):
        claimed |= {f"{k}{i:02d}" for i in range(int(a), int(b) + 1)}
    none = {"F21", "K07", "K08", "R10", "S25", "A06", "D04", "V06", "V12"}
    assert not claimed & none and none <= set(re.findall(r"\b[A-Z]\d\d\b", left_out))
