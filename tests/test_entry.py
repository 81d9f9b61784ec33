import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_does_not_need_the_corpus_subpackage():
    code = "import importlib.util as u; real = u.find_spec; u.find_spec = lambda n: None if n in ('quire.llm', 'corpus_pipeline') else real(n); import __spark_entry__ as e; assert 'clean_text' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries() if q[2:3].isdigit() or q == 'pipeline')"
    subprocess.run([sys.executable, "-c", code], check=True)
