import tracemalloc

import numpy as np

from threadline.llm import bwtdedup


def test_merge_holds_few_arrays():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 150, np.uint8)
    texts = []
    for _ in range(2000):
        t = base.copy()
        t[rng.integers(0, 150, 3)] = 65
        texts.append(t.tobytes())
    n = len(texts)
    tracemalloc.start()
    found = bwtdedup.repeated_windows(texts, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 140 * 150 * n
