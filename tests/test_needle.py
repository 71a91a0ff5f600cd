"""Stages of a growing corpus and the paired test between them."""

import math
import random

from quire.operators.corpus import needle_p, staged_best


def test_staged_best(spark):
    rng = random.Random(4)
    rows = [(q, s, v, rng.randint(0, 6) / 4) for q in range(5) for v, s in enumerate(rng.choices(["x", "y", "z"], k=30)) if not (q == 3 and s == "y")]
    added = []
    for s in "xyz":
        best = [r for q in range(5) for r in sorted((r for r in rows if r[:2] == (q, s)), key=lambda r: (-r[3], r[2]))[:4]]
        added.append((s, spark.createDataFrame([(q, v, score) for q, _, v, score in best], "query_id int, vec int, score double")))
    got = {(r.stage, r.query_id, r["rank"]): r.vec for r in staged_best(added, 4, "vec").collect()}
    want = {}
    for stage in ("x", "xy", "xyz"):
        for q in range(5):
            found = sorted((r for r in rows if r[0] == q and r[1] in stage), key=lambda r: (-r[3], r[2]))[:4]
            want.update({(stage[-1], q, i + 1): r[2] for i, r in enumerate(found)})
    assert got == want


def test_needle_p(spark):
    schema = "stage string, query_id int, recall int"
    down, up, same = 9, 2, 5
    rows = [("control", i, int(i < down or i >= down + up)) for i in range(16)] + [("noisy", i, int(i >= down)) for i in range(16)]
    n = down + up
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * (n**3 - n)) / 24)
    want = math.erfc(abs(up * (n + 1) / 2 - n * (n + 1) / 4) / spread / math.sqrt(2))
    assert n + same == 16 and abs(needle_p(spark.createDataFrame(rows, schema)).first()[0] - want) < 1e-12
    assert needle_p(spark.createDataFrame([(s, 1, 1) for s in ("control", "noisy")], schema)).first()[0] == 1.0
    assert needle_p(spark.createDataFrame([("control", 1, 1)], schema)).count() == 0
