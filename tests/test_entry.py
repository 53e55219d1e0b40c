"""The catalogue with and without the training-data operators."""

import subprocess
import sys

CODE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("p1_") for k in e.queries()), "knn_text_search" in e.queries())
"""


def names(*blocked):
    out = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1]), out[2] == "True", out[3] == "True"


def test_core_stands_without_what_the_subpackage_needs():
    alone = names("murmura.llm")
    assert alone[2:] == (False, True)
    for library in ("tiktoken", "xxhash", "regex"):
        assert names("murmura.llm.queries", library) == alone
        n = names(library)
        assert n == alone or n[2]
