"""Cases at the edges of bounds that the corpus operators once had, against exact results."""

import numpy as np
import pyarrow as pa

from docuquarry.llm import minhash


def meets(a, b):
    """The pairs that the third round lets through of two sets of 64-bit hashes with equal registers."""
    regs = np.ones(minhash.ESTIMATE, np.uint8).tobytes()
    rows = [(7, 0, 0, 0, i, i, len(s), regs, s.astype(np.uint32).tobytes()) for i, s in enumerate((a, b))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "x", "y", "block", "id", "comp", "n", "regs", "set"])
    return [tuple(r.values()) for out in minhash._meet(75)(iter([batch])) for r in out.to_pylist()]


def test_sets_whose_hashes_fall_together_still_meet():
    """60 shared of 80 elements, 20 of them equal in their lower 32 bits to others."""
    shared = np.concatenate([np.arange(40), np.arange(20) + (1 << 32)]).astype(np.uint64)
    a, b = (np.concatenate([shared, np.arange(10) + k]).astype(np.uint64) for k in (1000, 2000))
    assert 100 * len(np.intersect1d(a, b)) == 75 * len(np.union1d(a, b))
    assert meets(a, b) == [(0, 1)]


def test_sets_below_the_threshold_do_not_meet():
    a, b = (np.concatenate([np.arange(59), np.arange(11) + k]).astype(np.uint64) for k in (1000, 2000))
    assert meets(a, b) == []
