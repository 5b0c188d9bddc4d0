import subprocess
import sys
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from corvina.functions.stemmer import stem

ROOT = Path(__file__).resolve().parents[1]


@given(st.text(alphabet="abcdeilmnorstuyáéíóúñ", max_size=18))
@settings(max_examples=300, deadline=None)
def test_stems_shrink(word):
    s = stem(word)
    assert len(s) <= len(word) + 1 and not set(s) & set("áéíóú")


def test_nothing_else_needs_the_optional_subpackage():
    """With the folder and the pipeline gone, the registry still has the other queries."""
    code = "import sys; sys.modules['corvina.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rank_tfidf_topk' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
