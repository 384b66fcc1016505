"""Rows of a key in order, a batch at a time."""

import numpy as np

from rhythmspan.ordered import walked


def test_many_short_keys_and_a_long_one_go_by_as_arrays(spark):
    """Keys that begin or end within a batch, or go over many; a missing step is null, also as a whole number."""

    class Steps:
        """Each row's step from the row before; the last row of a key is held until the key ends."""

        def __init__(self):
            self.held, self.before = None, np.nan

        def take(self, rows):
            assert all(isinstance(v, np.ndarray) for v in rows.values())
            rows = rows if self.held is None else {c: np.r_[self.held[c], v] for c, v in rows.items()}
            self.held = {c: v[-1:] for c, v in rows.items()}
            return self._stepped({c: v[:-1] for c, v in rows.items()})

        def _stepped(self, rows):
            if not len(rows["t"]):
                return None
            t = rows["t"].astype(float)
            step, self.before = np.diff(t, prepend=self.before), t[-1]
            return {"t": rows["t"], "step": step, "odd": rows["t"] % 2 == 1}

        def rest(self):
            return self._stepped(self.held)

    rows = spark.range(6000).selectExpr("if(id < 2000, 'long', concat('k', id % 1500)) as a", "cast(id % 2 as int) as b", "id * 3 as t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "257")
    got = walked(rows, ("a", "b"), ("t",), Steps, "a string, b int, t long, step long, odd boolean").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = set(), {}
    for i in range(6000):
        key = ("long" if i < 2000 else f"k{i % 1500}", i % 2)
        want.add((*key, i * 3, i * 3 - last[key] if key in last else None, i * 3 % 2 == 1))
        last[key] = i * 3
    assert len(got) == 6000 and {tuple(r) for r in got} == want
