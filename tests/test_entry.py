"""The entry points hold without the training-data subpackage, or with a part of what it needs missing."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def left(blocked: str) -> set[str]:
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class No:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r} or name.startswith({blocked!r} + '.'):
            raise ModuleNotFoundError('blocked', name=name)
sys.meta_path.insert(0, No())
import warnings
warnings.simplefilter('ignore')
import __spark_entry__ as e
print('NAMES', *e.queries())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    return set(out.rpartition("NAMES")[2].split())


def test_guard():
    alone = left("paperloom.llm")
    assert "timeline" in alone and not any(q.startswith("op") or q == "pipeline" for q in alone)
    assert left("xxhash") >= alone
    assert "pipeline" not in left("corpus_pipeline")
