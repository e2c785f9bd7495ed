"""Embedding links against all pairs."""

import numpy as np

from rainrisk.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    ids, n = [r[0] for r in rows], len(rows)
    sound = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    near = np.zeros((n, n), bool)
    for i in sound:
        for j in sound:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                near[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    root = list(range(n))
    changed = True
    while changed:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        changed, root = new != root, new
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root[i]] = min(least.get(root[i], ids[i]), ids[i])
    return near.sum(1), [least.get(r) for r in root]


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(200)]
    for g in range(8):
        centre = rng.standard_normal(16)
        # the third group is larger than the window and a block
        rows += [(1000 * (g + 1) + i, (centre + 0.08 * rng.standard_normal(16)).tolist(), None) for i in range(150 if g == 2 else 6)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(4)] + [(3, rows[1][1], 1), (None, rows[0][1], None)]
    rows += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * 16, 0), (7003, [float("nan")] * 16, 0), (7004, [float("inf")] + [1.0] * 15, 0), (7005, [None] + [1.0] * 15, 0),
             (7006, [1e-30] * 16, 0), (7007, [1e30] * 16, 0), (7008, [1.0, 2.0], 0), (7009, [2.0, 4.0], 0)]
    how = vectors.Passes(window=16, block=64)
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), how).collect()
    n_links, comps = plain(rows)
    assert len(got) == len(rows)
    want = sorted((str(r[0]), int(n), str(c)) for r, n, c in zip(rows, n_links, comps))
    have = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got)
    # no link is wrong, and what the windows miss stays within a tenth
    assert sum(n for _, n, _ in have) >= 0.9 * sum(n for _, n, _ in want)
    assert [h for h in have] == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}


def test_short_and_empty_partitions_keep_their_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 8))
    values = np.concatenate([base + 0.12 * rng.standard_normal(base.shape) for _ in range(4)])
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "cls long, vec array<double>")
    how = vectors.Passes(passes=3, window=25)
    rows = sorted((r["lane"], r["sig"], r["cls"]) for r in vectors.signatures(classes, how).collect())
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    want = {tuple(sorted((a[2], b[2]))) for i, a in enumerate(rows) for b in rows[i + 1:i + 1 + how.window] if a[0] == b[0] and unit[a[2]] @ unit[b[2]] >= how.min_cosine}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 4, 40, 90):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {(r["a"], r["b"]) for r in vectors.found_links(classes, how).collect()} == want, n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(want) > 50
