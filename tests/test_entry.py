import subprocess
import sys

BLOCKED = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert "latest_reusable_run" in found and set(sql) <= set(found)
print(len(found), sum(n.startswith("op") and n[2].isdigit() for n in found), "pipeline" in found)
"""


def counts(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], capture_output=True, text=True, check=True)
    n, numbered, pipeline = done.stdout.split()[-3:]
    return int(n), int(numbered), pipeline == "True"


def test_plain_queries_without_the_subpackage_or_what_it_needs():
    """Whether the folder is gone or one of its imports fails, the other queries stay."""
    for name in ("harrow.llm", "harrow.llm.common", "pyspark.cloudpickle_not_there"):
        n, numbered, pipeline = counts(name)
        assert n > 130
        if name.startswith("harrow"):
            assert numbered == 0 and not pipeline
    without_pipeline = counts("corpus_pipeline")
    assert without_pipeline[0] > 130 and not without_pipeline[2]
