"""The driver's contract."""

import subprocess
import sys

import __spark_entry__
from tests.conftest import SMALL


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert "a3_page_coverage" in __spark_entry__.queries() and SMALL


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_the_text_operators():
    """With the subpackage and the pipeline gone from sight the entry module still imports and has its queries."""
    code = "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'i1_replay' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
