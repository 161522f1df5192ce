"""Near-dedup works on bounded slices: what a worker holds doesn't grow with a batch, and the results stay."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexmill.llm import near_dedup as N


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_likelihoods_come_in_slices():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, (10_000, N.REGISTERS)).astype(np.uint16)
    b, n, m = a[::-1].copy(), rng.integers(1, 99, 10_000) * 1.0, rng.integers(1, 99, 10_000) * 1.0
    got, mb = peak(lambda: N.likelihood_jaccard(a, b, n, m))
    assert mb < 12
    for at in (0, 1023, 1024, 9999):
        assert got[at] == N.likelihood_jaccard(a[at : at + 1], b[at : at + 1], n[at : at + 1], m[at : at + 1])[0]
    assert len(N.likelihood_jaccard(a[:0], b[:0], n[:0], m[:0])) == 0


def test_shared_counts_of_a_block_pair():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, 150)) for _ in range(512)]
    got, mb = peak(lambda: N._shared_counts(sets))
    assert mb < 14
    for i, j in ((0, 0), (1, 2), (511, 3)):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j])) or i == j
    assert N._shared_counts([np.array([1]), np.array([2])]).tolist() == [[0, 0], [0, 0]]


def test_batches_are_sliced_and_sketches_are_whole():
    texts = [f"a{i} b c d e{i % 7} f" for i in range(2500)] + [None, "", " ".join(f"w{i}" for i in range(3000))]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    for run in (N._sketch_batches(5), N._set_batches(5)):
        out = list(run(iter([batch])))
        assert [b.num_rows for b in out] == [1024, 1024, 455]
    sketch = pa.Table.from_batches(list(N._sketch_batches(5)(iter([batch]))))
    assert sketch["doc_id"].to_pylist() == list(range(len(texts)))
    s = N.shingle_set(texts[-1], 5)
    whole = np.clip(np.floor(1 - np.log(-np.log1p(-(_lowest(s) + 0.5) / 2**32) / N.RATE) / np.log(N.BASE)), 0, N.TOP + 1).astype(np.uint16)
    assert sketch["registers"][-1].as_py() == whole.tobytes()


def _lowest(s):
    h = (s[:, None] ^ N._SEEDS) * N._MIX
    h = (h ^ (h >> np.uint64(32))) * N._MIX
    return (h >> np.uint64(32)).min(0).astype(np.uint32)
