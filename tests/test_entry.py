import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    for name in ("brook", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "brook" / "llm")], check=True)
    (tmp_path / "entry.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry; assert 'agg_block' in entry.queries() and not any(k.startswith('op1_') for k in entry.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_streaming(spark, tmp_path):
    from brook.streaming import start, stream_files

    importlib.import_module("brook.sources")
    spark.range(10).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "in"))
    s = stream_files(spark, str(tmp_path / "in"), "id long, k long")
    start(spark, "from s where id > 3 select id, k", {"s": s}, "brook_test", str(tmp_path / "ck")).awaitTermination()
    assert spark.table("brook_test").count() == 6
