import numpy as np
import pytest

from tests.llm.helpers import clashing, components
from txrisk.llm.embed_dedup import _forest, embedding_links, join_blocks

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, min_cos=0.95):
    ok = {}
    for i, v in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, np.float32).astype(float)
        if a is not None and len(a) and np.isfinite(a).all() and (a != 0).any():
            ok[i] = a / np.linalg.norm(a)
    ids = sorted(ok)
    links = [(i, j) for i in ids for j in ids if i < j and len(ok[i]) == len(ok[j])
             and ok[i] @ ok[j] >= min_cos]
    n = dict.fromkeys([i for i, _ in rows], 0)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    comp = components([i for i, _ in rows], links)
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}


def _run(df, **kw):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
            for r in embedding_links(df, **kw).collect()}


def _clusters(rng, d=16):
    """A third of the vectors in one dense group, chains, scattered rest."""
    out = [rng.normal(size=d) for _ in range(200)]
    c = rng.normal(size=d)
    out += [c + rng.normal(size=d) * 0.05 for _ in range(150)]
    chain = rng.normal(size=d)
    for _ in range(40):
        chain = chain + rng.normal(size=d) * 0.18
        out.append(chain)
    return out


def test_against_brute_force_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in
            zip(rng.permutation(390), _clusters(rng))]
    rows[5] = (rows[5][0], None)
    rows[6] = (rows[6][0], [0.0] * 16)
    rows[7] = (rows[7][0], [float("nan")] + [1.0] * 15)
    rows[8] = (rows[8][0], [None] + [1.0] * 15)
    rows[9] = (rows[9][0], [float("inf")] + [1.0] * 15)
    rows[10] = (rows[10][0], [])
    rows[11] = (rows[11][0], rows[12][1][:7])
    rows[13] = (rows[13][0], [1e30 * x for x in rows[12][1]])
    df = clashing(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA))
    want = _brute(rows)
    assert max(x[0] for x in want.values()) > 100
    assert _run(df, block=32) == want
    assert _run(df) == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (2, v, 0), (3, w, 0), (None, v, 0)], SCHEMA)
    rows = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                   for r in embedding_links(df).collect()), key=str)
    assert rows == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True),
                           (None, 0, None, False)], key=str)
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_join_blocks_counts_and_connects(leaf):
    rng = np.random.default_rng(leaf)
    u = rng.normal(size=(60, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    eps = np.sqrt(2 - 2 * 0.9)
    for a, b, same in ((u, u, True), (u[:35], u[35:], False)):
        na, nb, links = join_blocks(a, b, a, b, same, 0.9, eps, leaf)
        hit = a @ b.T >= 0.9
        if same:
            np.fill_diagonal(hit, False)
        assert (na == hit.sum(1)).all()
        if not same:
            assert (nb == hit.sum(0)).all()
        shift = 0 if same else 1000
        full = [(int(x), int(y) + shift) for x, y in zip(*np.nonzero(hit))]
        nodes = {x for e in full for x in e}
        got = [(int(x), int(y) + shift) for x, y in links]
        assert components(nodes, got) == components(nodes, full)


def test_forest_is_small_for_a_dense_block():
    assert len(_forest(np.ones((50, 70), bool))) == 119
