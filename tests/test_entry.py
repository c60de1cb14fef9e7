import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["xxhash", "public_tokenizers", "corpus_pipeline", "talkgauge.llm"])
def test_engine_needs_neither_the_subpackage_nor_its_packages(blocked):
    """With any of these missing the entry still imports, with the queries of the engine alone."""
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; from talkgauge import catalog; print(set(e.queries()) == set(catalog.QUERIES), set(e.oracle_sql()) == set(catalog.ORACLES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["True", "True"], done.stderr
