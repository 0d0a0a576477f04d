import numpy as np

from tidemark.llm import embed_dedup
from tidemark.llm.embed_dedup import link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, e array<double>, n long, rep long, home int"


def brute(rows, cosine=0.95):
    sound = {}
    for i, e in sorted(rows, key=lambda r: str(r)):
        if i is not None:
            sound.setdefault(i, e)
    out = {i: [0, i] for i in sound}
    unit = {i: np.array(e, np.float32).astype(float) for i, e in sound.items() if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    unit = {i: e / np.linalg.norm(e) for i, e in unit.items()}
    links = {(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine}
    for i, _ in links:
        out[i][0] += 1
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if out[j][1] < out[i][1]:
                out[i][1], changed = out[j][1], True
    return {i: tuple(x) for i, x in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, [0.5], 1, 2, 3) for i, e in rows], SCHEMA)


def vectors(seed=2, n=200, dim=8):
    r, rows = np.random.default_rng(seed), []
    centres = r.normal(size=(12, dim))
    for i in range(n):
        u = r.random()
        v = centres[r.integers(12)] + r.normal(size=dim) * 0.25 if u < 0.7 else r.normal(size=dim)
        rows.append((int(i * 7 % 1009), [float(np.float32(x)) for x in v]))
        if u < 0.1:
            rows.append((2000 + i, rows[-1][1]))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = vectors()
    for cell, natives, members in ((8192, 8 << 20, 16 << 20), (20, 16 * 64, 24 * 64)):
        monkeypatch.setattr(embed_dedup, "CELL", cell)
        monkeypatch.setattr(embed_dedup, "NATIVES", natives)
        monkeypatch.setattr(embed_dedup, "MEMBERS", members)
        got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(frame(spark, rows)).collect()}
        assert got == brute(rows)


def test_cells_hold_all_that_is_near_and_little_else():
    """Each vector goes to the cell of every vector within the radius; in clusters that are apart, to few others."""
    radius = np.sqrt(2 - 2 * 0.95)
    for spread, most in ((0.02, 1.5), (0.35, 16)):
        r = np.random.default_rng(1)
        centres = r.normal(size=(16, 64))
        e = centres[r.integers(16, size=600)] / 8 + r.normal(size=(600, 64)) * spread / 2
        e /= np.linalg.norm(e, axis=1)[:, None]
        pivots = embed_dedup._pivots(centres / np.linalg.norm(centres, axis=1)[:, None])
        cells = [embed_dedup._cells(x, pivots, radius)[0] for x in e]
        near = e @ e.T >= 0.95
        assert all(cells[j][0] in cells[i] for i, j in zip(*np.nonzero(near))) and np.mean([len(c) for c in cells]) <= most


def test_odd_rows(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (6, [2.0, 2.0]), (7, [1.0, 1.0, 0.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1e-30, 1e-30]), (11, [3e38, 3e38]), (None, [1.0, 1.0]), (12, [1.0, 1.0]), (12, [1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert got[12] == (4, 5)
    assert link_vectors(frame(spark, [])).count() == 0
