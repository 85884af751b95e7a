"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are linked when their cosine is at least ``min_cos``, that is when
their distance is at most eps = sqrt(2 - 2 * min_cos). Vectors are projected on
leading principal directions and sorted by the grid cells (side eps) of these
coordinates. The sorted sequence is cut into blocks of bounded size that never
cross a cell of the leading grid dimensions, so a crowded cell becomes many
blocks. Two blocks can hold a link only if their leading cells are equal or
neighbours and their boxes are within eps; such pairs of blocks meet in an
equi-join. A pair is joined by recursion on halves of both intervals, skipping
intervals whose boxes are provably distant, down to leaves that are compared by
one matrix product in double precision.

A leaf gives link counts per vector and a spanning forest of its links, never
the pairs themselves, so a dense group costs rows in proportion to its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import store
from txrisk.llm.components import connected_components

DIMS = 8                 # principal coordinates that order and bound the vectors
GRID = 2                 # leading coordinates whose cells blocks never cross
SAMPLE = 4096            # vectors the directions are fitted on (smallest id hashes)
BLOCK = 4096             # vectors per block
LEAF = 128
SLACK = 1e-9             # on distance bounds, so rounding never skips a link


def usable(x, kind: str) -> np.ndarray | None:
    """A vector that counts (non-null, finite, non-zero) in its stored type, else None."""
    if not x.is_valid or not len(x) or x.values.null_count:
        return None
    v = x.values.to_numpy(zero_copy_only=False).astype(kind)
    return v if np.isfinite(v).all() and v.any() else None


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one (scaled first, so no norm overflows)."""
    u = rows.astype(np.float64)
    u /= np.abs(u).max(1)[:, None]
    return u / np.sqrt((u * u).sum(1))[:, None]


def matrix(raw: bytes, length: int, kind: str) -> np.ndarray:
    return unit(np.frombuffer(raw, kind).reshape(-1, length))


def principal_directions(vectors: DataFrame, sample: int, dims: int,
                         kind: str) -> dict[int, np.ndarray]:
    """Leading directions by vector length, from a bounded sample; any
    orthonormal directions give right results, these order best."""

    def units(batches):
        for b in batches:
            good = [v for v in (usable(x, kind) for x in b.column(1)) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit(v[None, :])[0] for v in good], pa.list_(pa.float64()))], ["u"])

    rows = (vectors.where("id is not null and vec is not null")
            .orderBy(F.xxhash64(F.lit("directions"), "id"), "id").limit(sample)
            .mapInArrow(units, "u array<double>").collect())
    by_len: dict[int, list] = {}
    for r in rows:
        by_len.setdefault(len(r["u"]), []).append(r["u"])
    out = {}
    for d, us in by_len.items():
        x = np.array(us)
        val, vec = np.linalg.eigh(x.T @ x)
        out[d] = np.ascontiguousarray(vec[:, ::-1][:, :dims])
    return out


def _coords(u: np.ndarray, basis: dict[int, np.ndarray], dims: int) -> np.ndarray:
    b = basis.get(u.shape[1])
    x = u @ b if b is not None else u[:, :dims]
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _gap2(lo_a, hi_a, lo_b, hi_b) -> float:
    g = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return float(g @ g)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite link matrix as (row, column) links."""
    todo_r, todo_c = linked.any(1), linked.any(0)
    out = []
    for seed in np.flatnonzero(todo_r):
        if not todo_r[seed]:
            continue
        todo_r[seed] = False
        rows = [seed]
        while rows:
            r = rows.pop()
            cols = np.flatnonzero(linked[r] & todo_c)
            todo_c[cols] = False
            for c in cols:
                out.append((r, c))
                nxt = np.flatnonzero(linked[:, c] & todo_r)
                todo_r[nxt] = False
                out += [(x, c) for x in nxt]
                rows += nxt.tolist()
    return out


def join_blocks(ua, ub, xa, xb, same: bool, min_cos: float, eps: float, leaf: int = LEAF):
    """Link counts of both blocks and a spanning forest [(row of a, row of b)].

    ``ua, ub`` unit vectors, ``xa, xb`` their principal coordinates, in grid
    order; ``same``: both are one block, whose pairs count once (in the first counts).
    """
    na, nb = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64)
    links: list[tuple[int, int]] = []
    limit2 = (eps + SLACK) ** 2
    stack = [(0, len(ua), 0, len(ub))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        one = same and a0 == b0
        if not one and _gap2(xa[a0:a1].min(0), xa[a0:a1].max(0),
                             xb[b0:b1].min(0), xb[b0:b1].max(0)) > limit2:
            continue                              # provably distant
        if one and a1 - a0 > leaf:
            mid = (a0 + a1) // 2
            stack += [(a0, mid, a0, mid), (a0, mid, mid, a1), (mid, a1, mid, a1)]
        elif not one and max(a1 - a0, b1 - b0) > leaf:
            if a1 - a0 >= b1 - b0:
                mid = (a0 + a1) // 2
                stack += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
            else:
                mid = (b0 + b1) // 2
                stack += [(a0, a1, b0, mid), (a0, a1, mid, b1)]
        else:
            hit = ua[a0:a1] @ ub[b0:b1].T >= min_cos
            if one:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            na[a0:a1] += hit.sum(1)
            if not one:
                nb[b0:b1] += hit.sum(0)
            links += [(a0 + r, b0 + c) for r, c in _forest(hit)]
    return (na + nb, nb, links) if same else (na, nb, links)


def prepare(vectors: DataFrame, basis: dict, eps: float, dims: int, kind: str) -> DataFrame:
    """(id, sig, vec, cells): the vector's bytes and grid cells, null for vectors
    that link with nothing; sig tells apart vectors repeated under one id."""
    import xxhash

    def run(batches):
        for b in batches:
            vs = [usable(x, kind) for x in b.column(1)]
            raw = [None if v is None else v.tobytes() for v in vs]
            cells: list = [None] * len(vs)
            for i, v in enumerate(vs):
                if v is not None and b.column(0)[i].is_valid:
                    x = np.floor(_coords(unit(v[None, :]), basis, dims)[0] / eps)
                    cells[i] = [len(v), *x.astype(int).tolist()]
            sig = [xxhash.xxh3_64_intdigest(r or b"") - (1 << 63) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sig, pa.int64()), pa.array(raw, pa.binary()),
                 pa.array(cells, pa.list_(pa.int32()))], ["id", "sig", "vec", "cells"])

    return vectors.mapInArrow(run, "id long, sig long, vec binary, cells array<int>")


BLOCK_SCHEMA = ("block long, length int, cell array<int>, lo array<double>, hi array<double>, "
                "ids array<long>, sigs array<long>, vecs binary")


def cut_blocks(prepared: DataFrame, basis: dict, dims: int, grid: int, block: int,
               kind: str) -> DataFrame:
    """The vectors in epsilon grid order, cut into stored blocks."""

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        made, held, cell, last = 0, [], None, None

        def emit():
            nonlocal made, held
            raw = b"".join(h[2] for h in held)
            x = _coords(matrix(raw, cell[0], kind), basis, dims)
            made += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([cell[0]], pa.int32()),
                 pa.array([list(cell[1:])], pa.list_(pa.int32())),
                 pa.array([x.min(0).tolist()]), pa.array([x.max(0).tolist()]),
                 pa.array([[h[0] for h in held]]), pa.array([[h[1] for h in held]]),
                 pa.array([raw], pa.binary())],
                ["block", "length", "cell", "lo", "hi", "ids", "sigs", "vecs"])
            held = []
            return out

        for b in batches:
            for i, s, v, c in zip(b.column("id").to_pylist(), b.column("sig").to_pylist(),
                                  b.column("vec").to_pylist(), b.column("cells").to_pylist()):
                if (i, s) == last:                # a repeated row: counted once
                    continue
                c = tuple(c[:1 + grid])
                if held and (c != cell or len(held) == block):
                    yield emit()
                cell, last = c, (i, s)
                held.append((i, s, v))
        if held:
            yield emit()

    order = [F.col("cells")[k] for k in range(dims + 1)] + [F.col("id"), F.col("sig")]
    rows = prepared.where("cells is not null")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCK_SCHEMA)


def block_pairs(blocks: DataFrame, eps: float, grid: int) -> DataFrame:
    """(a, b) of all pairs of blocks, a block with itself included, that may hold a
    link: equal or neighbouring leading cells and boxes within eps."""
    steps = [()]
    for _ in range(grid):
        steps = [s + (d,) for s in steps for d in (-1, 0, 1)]
    steps = [s for s in steps if s >= (0,) * grid]   # each unordered pair of cells once
    meta = blocks.select("block", "length", "cell", "lo", "hi")
    a = meta.select(
        F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "length",
        F.explode(F.array(*[F.struct(
            F.array(*[F.col("cell")[k] + s[k] for k in range(grid)]).alias("cell"),
            F.lit(s == (0,) * grid).alias("home")) for s in steps])).alias("t"))
    a = a.select("a", "a_lo", "a_hi", "length", F.col("t.cell").alias("cell"), "t.home")
    b = meta.select(F.col("block").alias("b"), F.col("lo").alias("b_lo"),
                    F.col("hi").alias("b_hi"), "length", "cell")
    apart = F.zip_with(F.arrays_zip("a_lo", "a_hi"), F.arrays_zip("b_lo", "b_hi"),
                       lambda x, y: F.greatest(F.lit(0.0), y["b_lo"] - x["a_hi"],
                                               x["a_lo"] - y["b_hi"]))
    near = F.aggregate(apart, F.lit(0.0), lambda acc, g: acc + g * g) <= (eps + SLACK) ** 2
    return (a.join(b, ["length", "cell"])
            .where((~F.col("home") | (F.col("a") <= F.col("b"))) & near).select("a", "b"))


def link_blocks(blocks: DataFrame, pairs: DataFrame, basis: dict, dims: int, min_cos: float,
                eps: float, kind: str) -> DataFrame:
    """Rows (kind, x, y, n): kind 0 a vector (id, sig) with n links found in one
    pair of blocks; kind 1 a link (id, id) of the spanning forest."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name: b.column(name)[r].as_py()  # noqa: B023, E731
                n = get("length")
                ua, ub = matrix(get("va"), n, kind), matrix(get("vb"), n, kind)
                same = get("a") == get("b")
                ia, ib, sa, sb = get("ia"), get("ib"), get("sa"), get("sb")
                na, nb, links = join_blocks(ua, ub, _coords(ua, basis, dims),
                                            _coords(ub, basis, dims), same, min_cos, eps)
                rows = [(0, ia[k], sa[k], int(na[k])) for k in np.flatnonzero(na)]
                if not same:
                    rows += [(0, ib[k], sb[k], int(nb[k])) for k in np.flatnonzero(nb)]
                rows += [(1, ia[x], ib[y], 0) for x, y in links]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    ["kind", "x", "y", "n"])

    left = blocks.select(F.col("block").alias("a"), "length", F.col("ids").alias("ia"),
                         F.col("sigs").alias("sa"), F.col("vecs").alias("va"))
    right = blocks.select(F.col("block").alias("b"), F.col("ids").alias("ib"),
                          F.col("sigs").alias("sb"), F.col("vecs").alias("vb"))
    return (pairs.join(left, "a").join(right, "b")
            .mapInArrow(run, "kind int, x long, y long, n long"))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    min_cos: float = 0.95, dims: int = DIMS, grid: int = GRID,
                    sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing, and neither do rows without an id (component_id null, kept false) or
    vectors of different lengths with each other. Rows repeated with the same id
    and vector are one vector, reported for each of them. Empty tables give an
    empty result; other columns are ignored. The recursion compares vectors, not
    labels, in double precision.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"             # vectors travel in their own precision
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    eps = float(np.sqrt(2 - 2 * min_cos))
    basis = principal_directions(v, sample, dims, kind)
    prepared = store(prepare(v, basis, eps, dims, kind), "prepared-vectors")
    blocks = store(cut_blocks(prepared, basis, dims, grid, block, kind), "vector-blocks")
    pairs = block_pairs(blocks, eps, grid)
    found = store(link_blocks(blocks, pairs, basis, dims, min_cos, eps, kind), "vector-links")
    counts = (found.where("kind = 0").groupBy(F.col("x").alias("id"), F.col("y").alias("sig"))
              .agg(F.sum("n").alias("n_links")))
    labels = connected_components(found.where("kind = 1"), "x", "y")
    return (prepared.select("id", "sig").join(counts, ["id", "sig"], "left")
            .join(labels, F.col("id") == F.col("node"), "left")
            .select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("label", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
            .withColumnRenamed("id", id_col))
