"""What a Python worker keeps after a task."""

import subprocess
import sys

import pytest

from riskspark.llm import sentencepiece_codec, textblocks
from riskspark.llm.queries import model_file

SCRIPT = """
import sys
import numpy as np
from riskspark.llm import textblocks

def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20

kept = []
def work(batches):
    for _ in batches:
        parts = [np.ones(6000) for _ in range(6000)]
        kept.append(parts.pop())  # what lies above the freed blocks
        del parts
        yield None

before = held()
wrapped = textblocks.giving_back(work, iter([0])) if sys.argv[1] == "back" else work(iter([0]))
list(wrapped)
print(held() - before)
"""


def test_a_worker_gives_freed_memory_back():
    grown = {kind: int(subprocess.run([sys.executable, "-c", SCRIPT, kind], capture_output=True, text=True, check=True,
                                      cwd=textblocks.__file__.rsplit("/riskspark/", 1)[0]).stdout)
             for kind in ("kept", "back")}
    if grown["kept"] < 100:
        pytest.skip("this system's allocator keeps nothing")
    assert grown["back"] < 50


def test_the_codec_remembers_nothing_between_tasks(spark):
    """The same worker answers for the second frame; it has to start as the first task did."""
    def size(batches):
        import pyarrow as pa

        own = sentencepiece_codec.codec(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(own.known) + len(own.apart)] * batch.num_rows)], ["n"])

    file = model_file()
    docs = spark.createDataFrame([(i, f"words{i} and {i} others") for i in range(200)], "doc_id long, text string").coalesce(1)
    for encode in (sentencepiece_codec.digest_documents, sentencepiece_codec.encode_documents):
        assert encode(docs, file).count() == 200
        assert encode(docs, file).agg({"doc_id": "sum"}).first()[0] == sum(range(200))
        assert docs.select("doc_id").mapInArrow(size, "n long").agg({"n": "max"}).first()[0] == 0
