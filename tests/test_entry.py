"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "word" in df.columns


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators():
    code = "import sys; sys.modules['sequenza.llm'] = None\nimport __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
