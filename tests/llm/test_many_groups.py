"""More groups than are tried at once must be told apart."""

import numpy as np

from vocalith.llm import groups


def test_more_than_twelve_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 64))
    rows = [(i, "big", i % 20, [float(x) for x in centres[i % 20] + 0.03 * rng.standard_normal(64)]) for i in range(1200)]
    rows += [(2000 + i, "small", i % 2, [float(x) for x in centres[i % 2] + 0.03 * rng.standard_normal(64)]) for i in range(60)]
    got = groups.grouped(spark.createDataFrame(rows, "row_id long, source string, cluster_id int, vec array<float>")).collect()
    true = {}
    for r in got:
        true.setdefault((r["source"], r["grp"]), set()).add(r["cluster_id"])
    assert len(got) == 1260 and all(len(x) == 1 for x in true.values())
    assert {s for s, _ in true} == {"big", "small"} and len({k for s, k in true if s == "big"}) >= 20
