"""Every query against its oracle, on the smallest tables."""

import pytest
from strataleaf.plans import queries as Q

from tests.conftest import SF


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


def compared(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([norm(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert compared(df.columns, df.collect()) == compared(columns, want.fetchall())


def test_slices_document(spark):
    import json

    doc = json.loads(Q.QUERIES["slices_document"](spark, SF).first().document)
    assert set(doc) == {"config", "app/controllers/A.scala", "target/scala-3/x/routes.scala", "app/N.scala"}
    assert len(doc["config"]["routes"]) == 13
    assert doc["app/controllers/A.scala"] == {"sourceFile": "app/controllers/A.scala", "tags": ["framework-input", "framework-output"], "usedTypes": ["play.twirl.api.Html"], "literals": ["late", "other", "1 [app/controllers/A.scala]"]}


def test_deep_trees_leave_python_counted(spark, monkeypatch):
    """What Python sends back grows with the kinds of nodes, not with the nodes."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame

    sent, plain = Observation(), DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *a, **k: plain(*a, **k).observe(sent, F.count(F.lit(1)).alias("rows")))
    found = Q.QUERIES["json_walk_deep"](spark, SF).collect()
    assert sent.get["rows"] == len(found) < sum(r.n for r in found) / 50


def test_deep_trees_of_odd_texts(spark, duck, tmp_path):
    texts = ["", " ", "\n", "  a  b ", '"q" \\ \\n \\" {"type":"Word"},\n\ttab\u00a0nbsp \u2028x\r\n', "\U0001f600 é\x01\x1f", None, "x" * 3 + "\n" * 40, "[a, b] {c: d}"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = Q.ORACLES["json_walk_deep"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(sql)
    df = Q.QUERIES["json_walk_deep"](spark, str(tmp_path))
    assert compared(df.columns, df.collect()) == compared([d[0] for d in want.description], want.fetchall())


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    (to / "strataleaf" / "llm").mkdir()  # a folder may be left behind
    run = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q"
    done = subprocess.run([sys.executable, "-c", run], cwd=to, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(to)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
