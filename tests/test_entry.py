"""The entry points, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__
from tests.conftest import REPO


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_text_subpackage():
    code = "import sys; sys.modules['neurotab.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
