"""Results of a batch leave a Python task in slices."""

import pandas as pd

from corpusloom.operators import chunking


def test_chunks_leave_in_slices():
    n = 2 * chunking.AT_ONCE + 1
    made = list(chunking._chunks_of.func(iter([pd.Series([f"t{i}" for i in range(n)])])))
    assert [len(m) for m in made] == [chunking.AT_ONCE, chunking.AT_ONCE, 1]
    assert [c for m in made for c in m] == [[f"t{i}"] for i in range(n)]
