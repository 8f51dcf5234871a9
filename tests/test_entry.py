"""The driver contract: names agree, and the rest works without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from granary.plans import catalogue

REPO = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalogue.FLAGSHIP in catalogue.queries()


def run(code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", f"import sys; {code}"], cwd=REPO, capture_output=True, text=True)


def test_imports_without_the_optional_part():
    for gone in (["granary.llm"], ["corpus_pipeline"], ["granary.llm", "corpus_pipeline"]):
        hidden = "; ".join(f"sys.modules['{name}'] = None" for name in gone)
        done = run(f"{hidden}; import __spark_entry__ as e; assert set(e.queries()) == set(e.catalogue.queries()); e.oracle_sql()")
        assert done.returncode == 0, done.stderr


def test_another_missing_package_is_not_hidden():
    done = run("sys.modules['pyarrow'] = None; import __spark_entry__")
    assert done.returncode != 0 and "pyarrow" in done.stderr


def test_nothing_else_imports_the_optional_part():
    for path in (REPO / "granary").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text()


def test_flagship_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "similarity", "rank", "position"]
