"""What a Python worker keeps once a task has ended: it stays for others, and an executor has several."""

import subprocess
import sys

import pytest

#: MB that a worker may have more than after a first, tiny task.
KEPT = 60
RUN = """
import io, re
import numpy as np, pandas as pd, pyarrow as pa
from engramlake.llm import {module} as m

class Got(Exception):
    pass

class Frame:
    def select(self, *columns): return self
    where = select
    def mapInPandas(self, run, schema): raise Got(run)

def function(call):
    try:
        call()
    except Got as e:
        return e.args[0]

def held():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n=3, rows=1500):
    # As a worker gets them: read from a stream, into Arrow's own memory.
    rng = np.random.default_rng(1)
    for i in range(n):
        texts = [" ".join(f"w{{x}}" for x in rng.integers(0, 200_000, 800)) for _ in range(rows)]
        b = pa.RecordBatch.from_pandas(pd.DataFrame({{"rid": range(rows), "doc_id": range(rows), "lang": "en", "source": "s", "text": texts}}))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        del texts, b
        sink.seek(0)
        for x in pa.ipc.open_stream(sink):
            yield x.to_pandas()

def task(some):
    for out in run(some):
        pa.RecordBatch.from_pandas(out)

m.columns = lambda d: d
run = function(lambda: {call})
task(batches(1, 1))
before = held()
task(batches())
print(held() - before)
"""


@pytest.mark.parametrize("module,call", [("mixing", "m.blocks(Frame())")])
def test_worker_gives_memory_back(module, call):
    out = subprocess.run([sys.executable, "-c", RUN.format(module=module, call=call)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < KEPT


LANGUAGE_MODEL = """
import re
import numpy as np, pandas as pd
from engramlake.llm import lmscore as m

class Frame:
    def select(self, *columns): return self
    def mapInPandas(self, run, schema): return run

def held():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

rng = np.random.default_rng(1)
known = rng.integers(1, 1 << 62, m.VOCABULARY)
v = m.Vocabulary(known, np.arange(m.VOCABULARY, 0, -1), np.ones(m.ENDINGS), np.ones(m.ENDINGS))
flat = m.Model(v).flat

def train(n):
    m._trainer(flat, v, 0, 1 << 16)(pd.DataFrame({{"trainer": 0, "h": range(n), "ids": [rng.integers(0, v.size, 4098).astype(np.uint16).tobytes() for _ in range(n)]}}))

def score(n):
    for _ in m.score(Frame(), v, flat)(pd.DataFrame({{"doc_id": range(n), "codes": [known[rng.integers(0, len(known), 4096)].tobytes() for _ in range(n)]}}) for _ in range(3)):
        pass

{call}(1)
before = held()
{call}(250)
print(held() - before)
"""


@pytest.mark.parametrize("call", ["train", "score"])
def test_language_model_gives_memory_back(call):
    out = subprocess.run([sys.executable, "-c", LANGUAGE_MODEL.format(call=call)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < KEPT
