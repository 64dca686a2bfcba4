"""Rows of a key in order, whatever batches they come in."""

import pandas as pd

from ledgerlens.streaming.sessions import in_order


def test_order_over_batches_with_nulls_last():
    parts = [pd.DataFrame({"ms": [5.0, None], "id": [1, 2], "role": ["a", "b"]}), pd.DataFrame({"ms": [4.0, 5.0], "id": [3, 0], "role": ["c", None]})]
    assert [r[1:] for r in in_order(iter(parts), ("ms", "id"), "role")] == [(3, "c"), (0, None), (1, "a"), (2, "b")]
    assert in_order(iter([]), ("ms",)) == []
