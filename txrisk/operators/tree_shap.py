"""Tree SHAP, path-dependent (X2): exact Shapley values of tree ensembles.

A leaf is reached through tests on m different features. Feature j of that path has
o_j (1 if the row passes all the leaf's tests on it) and z_j (the share of training
rows that pass them, from the nodes' covers). With a set S of features known, the leaf
counts with its value times the product of o_j in S and z_j outside. Hence feature i
gets, from this leaf of value v,

    v (o_i - z_i) sum_k k! (m-1-k)! / m!  [t^k] prod_{j != i} (z_j + o_j t)

The products that leave one factor out come from the products before and after it, so
nothing is divided. The o_j of a row are one bit pattern per leaf; what a pattern gives
is computed once per leaf (short paths: for all 2^m patterns, kept for the task; long
ones: for the patterns that occur in the batch).
"""

from __future__ import annotations

import math

#: Paths of at most so many features have a table of all their patterns.
TABLE_BITS = 8


def leaf_paths(tree: dict) -> list[tuple]:
    """Per leaf of a tree (arrays left, right, feat, thr, val, cover; left < 0 at a
    leaf): (value, features, shares z, tests), tests being one list of (node, passes
    left) per feature."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree["left"][node] < 0:
            out.append((float(tree["val"][node]), list(path), [z for z, _ in path.values()],
                        [t for _, t in path.values()]))
            continue
        f, cover = int(tree["feat"][node]), tree["cover"][node]
        for child, left in ((int(tree["right"][node]), False), (int(tree["left"][node]), True)):
            share = tree["cover"][child] / cover if cover > 0 else 0.0
            z, tests = path.get(f, (1.0, []))
            stack.append((child, {**path, f: (z * share, [*tests, (node, left)])}))
    return out


def pattern_values(value: float, z: list[float], patterns):
    """Array (m, patterns): what a leaf gives its m features for bit patterns of o."""
    import numpy as np
    m = len(z)
    o = (patterns[None, :] >> np.arange(m)[:, None]) & 1

    def times(poly, j):          # poly * (z_j + o_j t)
        out = np.zeros((len(poly) + 1, len(patterns)))
        out[:-1] = poly * z[j]
        out[1:] += poly * o[j]
        return out

    before, after = [np.ones((1, len(patterns)))], [np.ones((1, len(patterns)))]
    for j in range(m - 1):
        before.append(times(before[-1], j))
        after.append(times(after[-1], m - 1 - j))
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = np.zeros((m, len(patterns)))
    for i in range(m):
        left, right = before[i], after[m - 1 - i]
        for a in range(len(left)):
            for b in range(len(right)):
                out[i] += weight[a + b] * left[a] * right[b]
        out[i] *= value * (o[i] - z[i])
    return out


class TreeShap:
    """Contributions of an ensemble's trees (tables as of ``explain.tree_tables``)."""

    def __init__(self, trees: list[dict], n_features: int):
        self.trees, self.n = trees, n_features
        self.paths = [leaf_paths(t) for t in trees]
        self.tables: dict = {}
        self.scale = 1.0 if not trees or trees[0]["boosted"] else 1.0 / sum(t["w"] for t in trees)
        #: expected value: leaves by the share of training rows that reach them
        self.bias = self.scale * sum(t["w"] * sum(v * math.prod(z) for v, _, z, _ in p)
                                     for t, p in zip(trees, self.paths)) \
            + sum(t.get("base", 0.0) for t in trees)

    def contributions(self, x):
        """Array (rows, features) for a matrix of feature values. NaN goes where the
        model sends it: above all thresholds in Spark's trees, below in ``boosting``'s."""
        import numpy as np
        nan = self.trees[0].get("nan", np.inf) if self.trees else np.inf
        x = np.asfortranarray(np.where(np.isnan(x), nan, x))
        out = np.zeros((self.n, len(x)))
        for k, (tree, paths) in enumerate(zip(self.trees, self.paths)):
            inner = np.flatnonzero(np.asarray(tree["left"]) >= 0)
            passed = {int(i): x[:, tree["feat"][i]] <= tree["thr"][i] for i in inner}
            for leaf, (value, features, z, tests) in enumerate(paths):
                if not features:
                    continue
                code = np.zeros(len(x), np.int64)
                for j, steps in enumerate(tests):
                    ok = np.ones(len(x), bool)
                    for node, left in steps:
                        ok &= passed[node] if left else ~passed[node]
                    code |= ok.astype(np.int64) << j
                value *= tree["w"] * self.scale
                if len(features) <= TABLE_BITS:
                    if (k, leaf) not in self.tables:
                        self.tables[k, leaf] = pattern_values(value, z, np.arange(1 << len(features)))
                    out[features] += self.tables[k, leaf][:, code]
                else:
                    seen, at = np.unique(code, return_inverse=True)
                    out[features] += pattern_values(value, z, seen)[:, at]
        return out.T
