import subprocess
import sys
from pathlib import Path


def names(before: str) -> list[str]:
    code = f"import sys; {before}; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()


def test_core_queries_work_without_the_rest():
    """A library of the training-data operators that isn't there costs these operators only."""
    core = names("sys.modules['xxhash'] = None")
    assert len(core) > 60 and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in core)
    assert names("sys.modules['weftcorpus.llm'] = None") == core == names("sys.modules['corpus_pipeline'] = None")
    assert names("pass")[: len(core)] == core
