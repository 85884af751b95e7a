"""Explanations as Spark jobs.

A linear contribution is coef * (x - mean) / scale. Contributions of a batch of
rows are one matrix expression in an Arrow batch, and per-row rankings (top
reasons, explained alerts) one sort along its rows, so nothing shuffles by row
id; the long table (id, feature, value, contribution) is produced only when asked
for, and global importance adds up one row per feature and batch. (As column
expressions, 29 features with their ranking generate methods beyond the JVM's
compile limit; measured, that is several times slower.) Contributions of tree
ensembles (Tree SHAP, or plain path attribution) run on Arrow batches with the tree
arrays broadcast.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round
from txrisk.operators.boosting import BoostedModel
from txrisk.operators.forest import ForestModel
from txrisk.operators.tree_shap import TreeShap

TOP_K_DEFAULT = 6


# --------------------------------------------------------------------------- coefficients

def correlation_coefficients(df: DataFrame, features: list[str], label: str = "isFraud") -> dict:
    """Coefficients of a standardized linear scorer whose weight per feature
    is its Pearson correlation with the label: {feature: (coef, mean, scale)}.
    One aggregation pass; a constant feature gets coef 0. The result has one
    entry per feature (bounded), so it is read to the driver as literals."""
    # long form (feature, x, y): a few buffers per group keep the aggregation
    # in generated code (one row of ~100 buffers would not)
    stack = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.selectExpr(f"CAST(`{label}` AS DOUBLE) AS y", f"stack({len(features)}, {stack}) AS (f, x)")
    den = F.stddev_samp("x") * F.stddev_samp("y")
    rows = long.groupBy("f").agg(
        F.when(den > 0, F.covar_samp("x", "y") / den).otherwise(F.lit(0.0)).alias("c"),
        F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()
    got = {r["f"]: (r["c"], r["m"], r["s"]) for r in rows}
    return {f: got.get(f, (0.0, 0.0, 0.0)) for f in features}


def model_coefficients(features: list[str], coef: list[float], mean: list[float],
                       scale: list[float]) -> dict:
    """Coefficients of a fitted scaler + linear model, same layout."""
    return {f: (float(c), float(m), float(s)) for f, c, m, s in zip(features, coef, mean, scale)}


# --------------------------------------------------------------------------- contributions

def contributions_of(x, coefs: dict, features: list[str], digits: int | None = None):
    """X1 on a matrix (rows x features): coef * (x - mean) / scale, 0 where the
    scale is 0 or missing; optionally rounded half up to ``digits`` places (only
    to compare engines)."""
    import numpy as np
    c, mean, scale = (np.array([coefs[f][i] or 0.0 for f in features]) for i in range(3))
    ok = scale > 0
    out = c * np.where(ok, (x - mean) / np.where(ok, scale, 1.0), 0.0)
    if digits is not None:
        unit = float(10 ** digits)
        out = np.floor(out * unit + 0.5) / unit
    return out


def _matrix(columns):
    import numpy as np
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])


def _doubles(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    return df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features])


def linear_contributions(df: DataFrame, coefs: dict, features: list[str], id_col: str = "tx_id",
                         digits: int | None = None) -> DataFrame:
    """X1, long: (id, feature, value, contribution)."""
    import numpy as np

    def run(batches):
        names = pa.array(features)
        for b in batches:
            x = _matrix(b.columns[1:])
            c = contributions_of(x, coefs, features, digits)
            at = np.tile(np.arange(len(features), dtype=np.int32), len(x))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(features))))
            yield pa.RecordBatch.from_arrays(
                [ids, names.take(pa.array(at)), pa.array(x.reshape(-1)), pa.array(c.reshape(-1))],
                [id_col, "feature", "value", "contribution"])

    kind = df.schema[id_col].dataType.simpleString()
    return _doubles(df, features, id_col).mapInArrow(
        run, f"`{id_col}` {kind}, feature string, value double, contribution double")


def global_importance(df: DataFrame, coefs: dict, features: list[str], id_col: str = "tx_id",
                      digits: int | None = None) -> DataFrame:
    """Mean |contribution| per feature; tasks send one row per feature and batch."""
    import numpy as np

    def run(batches):
        for b in batches:
            c = np.abs(contributions_of(_matrix(b.columns[1:]), coefs, features, digits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(features), pa.array(c.sum(0)), pa.array([len(c)] * len(features))],
                ["feature", "s", "n"])

    part = _doubles(df, features, id_col).mapInArrow(run, "feature string, s double, n long")
    return part.groupBy("feature").agg(
        (F.sum("s") / F.sum("n")).alias("mean_abs_contribution"))


REASONS = ("struct<margin:double,toward:array<struct<feature:string,value:double,contribution:double>>,"
           "against:array<struct<feature:string,value:double,contribution:double>>>")


def reasons(coefs: dict, features: list[str], k: int = TOP_K_DEFAULT,
            digits: int | None = None) -> Column:
    """X5 as a column over a feature frame: margin (sum of the contributions), the k
    largest positive contributions (largest first) and the k most negative ones,
    the last k of the descending order. Ties by feature name."""
    names = sorted(features)
    return _ranked(names, k, lambda: lambda x: contributions_of(x, coefs, names, digits))


def tree_reasons(spark, trees: list[dict], features: list[str], k: int = TOP_K_DEFAULT) -> Column:
    """``reasons`` by the Tree SHAP values of an ensemble (``tree_tables``)."""
    import numpy as np
    names, shared = sorted(features), spark.sparkContext.broadcast(trees)
    at = [features.index(f) for f in names]

    def contribute():
        shap, back = TreeShap(shared.value, len(features)), np.argsort(at)
        return lambda x: shap.contributions(x[:, back])[:, at]

    return _ranked(names, k, contribute)


def _ranked(names: list[str], k: int, contribute) -> Column:
    """REASONS of the columns ``names`` (ascending); ``contribute()`` gives, once per
    task, the function from values to contributions."""
    import numpy as np

    k, made = min(k, len(names)), []

    def picked(x, c, order, take):
        idx = order[take]
        rows = np.repeat(np.arange(len(x)), take.sum(1))
        items = pa.StructArray.from_arrays(
            [pa.array(names).take(pa.array(idx)), pa.array(x[rows, idx]), pa.array(c[rows, idx])],
            ["feature", "value", "contribution"])
        ends = np.concatenate([[0], np.cumsum(take.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), items)

    def run(row: pa.Array) -> pa.Array:
        x = _matrix(row.flatten())
        if not made:
            made.append(contribute())
        c = made[0](x)
        order = np.argsort(-c, axis=1, kind="stable")   # names ascend, so ties do
        place = np.arange(len(names))[None, :]
        n_pos, n_neg = (c > 0).sum(1)[:, None], (c < 0).sum(1)[:, None]
        first = place < np.minimum(n_pos, k)
        last = place >= len(names) - np.minimum(n_neg, k)
        return pa.StructArray.from_arrays(
            [pa.array(c.sum(1)), picked(x, c, order, first), picked(x, c, order, last)],
            ["margin", "toward", "against"])

    return F.arrow_udf(run, REASONS)(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))


def top_reasons_rows(df: DataFrame, coefs: dict, features: list[str], k: int = TOP_K_DEFAULT,
                     id_col: str = "tx_id", digits: int | None = None) -> DataFrame:
    """(id, direction, rank, feature, value, contribution)."""
    return reason_rows(df.select(id_col, reasons(coefs, features, k, digits).alias("reasons")), id_col)


def reason_rows(df: DataFrame, id_col: str = "tx_id") -> DataFrame:
    """A ``reasons`` column as rows: (id, direction, rank, feature, value, contribution)."""
    both = F.array(F.struct(F.lit("fraud").alias("direction"), F.col("reasons.toward").alias("items")),
                   F.struct(F.lit("not_fraud").alias("direction"), F.col("reasons.against").alias("items")))
    e = df.select(id_col, F.explode(both).alias("d")).select(
        id_col, "d.direction", F.posexplode("d.items").alias("pos", "r"))
    return e.select(id_col, "direction", (F.col("pos") + 1).alias("rank"), "r.*")


def top_reasons(contrib: DataFrame, k: int = TOP_K_DEFAULT, id_col: str = "tx_id",
                by: str = "contribution") -> DataFrame:
    """X5 on a long table (e.g. forest contributions): per row, the k largest
    positive contributions (rank 1 = largest) and the k most negative ones,
    i.e. the last k of the descending order. Ties by feature name."""
    pos = contrib.where(F.col(by) > 0)
    neg = contrib.where(F.col(by) < 0)
    wp = Window.partitionBy(id_col).orderBy(F.desc(by), F.asc("feature"))
    wn_tail = Window.partitionBy(id_col).orderBy(F.asc(by), F.desc("feature"))
    p = pos.withColumn("rank", F.row_number().over(wp)).where(F.col("rank") <= k) \
        .withColumn("direction", F.lit("fraud"))
    n = (neg.withColumn("_tail", F.row_number().over(wn_tail)).where(F.col("_tail") <= k)
         .withColumn("rank", F.row_number().over(Window.partitionBy(id_col)
                                                 .orderBy(F.desc(by), F.asc("feature"))))
         .drop("_tail").withColumn("direction", F.lit("not_fraud")))
    return p.unionByName(n)


def _py_str_float(v: Column) -> Column:
    """str(float(v)) as Python prints it for the values this sees (integral
    values get a trailing .0; others use the shortest repr)."""
    integral = (v == F.floor(v)) & (F.abs(v) < F.lit(1e16))
    return F.when(integral, F.concat(v.cast("long").cast("string"), F.lit(".0"))) \
        .otherwise(v.cast("string"))


# Reason templates per feature (text must equal the original's).
REASON_TEMPLATES = {
    "sender_account_emptied": "Sender account became zero after transaction (account emptied).",
    "is_large_transaction": "Transaction amount is unusually large (top percentile).",
    "amount_to_oldbalance_orig_ratio":
        "Amount is high relative to sender's old balance (ratio={2f}).",
    "balance_error_orig": "Origin balance update is inconsistent with expected transaction logic.",
    "balance_error_dest": "Destination balance update is inconsistent with expected transaction logic.",
    "type_risk_score": "Transaction type has higher fraud risk weight (risk score={str}).",
    "transactions_in_step": "High activity at this time step (transactions_in_step={str}).",
    "is_high_velocity_step": "Transaction occurred in a high-velocity time step (burst activity).",
    "dest_received_large_amount": "Destination account received amount starting from zero balance.",
}
DEFAULT_REASON = "{feature} contributed to fraud risk."


def reason_text(feature: Column, value: Column) -> Column:
    """Business-readable reason for a (feature, value)."""
    two = F.format_string("%.2f", py_round(value, 2))
    as_str = _py_str_float(value)
    expr = None
    for f, t in REASON_TEMPLATES.items():
        if "{2f}" in t:
            a, b = t.split("{2f}")
            txt = F.concat(F.lit(a), two, F.lit(b))
        elif "{str}" in t:
            a, b = t.split("{str}")
            txt = F.concat(F.lit(a), as_str, F.lit(b))
        else:
            txt = F.lit(t)
        expr = F.when(feature == f, txt) if expr is None else expr.when(feature == f, txt)
    a, b = DEFAULT_REASON.split("{feature}")
    return expr.otherwise(F.concat(F.lit(a), feature, F.lit(b)))


def explained_alerts(scored: DataFrame, id_col: str = "tx_id") -> DataFrame:
    """One record per alerted row with its ordered top reasons toward fraud and
    their texts, from a scored frame with ``alert`` and the ``reasons`` column."""
    top = F.transform("reasons.toward", lambda r: F.struct(
        r["feature"].alias("feature"), r["value"].alias("value"),
        r["contribution"].alias("shap_contribution"),
        reason_text(r["feature"], r["value"]).alias("reason_text")))
    return scored.where(F.col("alert").isNotNull()).select(
        id_col, F.col("alert.alert_id").alias("alert_id"),
        F.col("alert.transaction_ref").alias("transaction_ref"),
        F.col("alert.created_at").alias("created_at_utc"),
        F.col("ml_probability").alias("fraud_probability"),
        F.col("ml_risk_score").alias("risk_score"), F.col("ml_risk_level").alias("risk_level"),
        F.col("ml_action").alias("recommended_action"), top.alias("top_reasons"))


# --------------------------------------------------------------------------- forests

def tree_tables(model, spark) -> list[dict]:
    """Node arrays of every tree of a fitted tree-ensemble classifier: left and right
    child (-1 at a leaf), feature, threshold, value, and cover (training rows, weighted
    as in training). Spark's are read from the model's saved data; one row per node, so
    the size is the model's (200 trees of depth 12: at most 90 MB, whatever the data).

    A forest's trees hold class shares and are averaged to the probability; a
    boosted model's are regression trees whose weighted predictions add up to the
    margin (probability = 1 / (1 + exp(-2 * margin)))."""
    import numpy as np
    from pyspark.ml.classification import GBTClassificationModel

    from txrisk.session import scratch_path

    if isinstance(model, ForestModel):
        return [{"left": np.where(t["feat"] >= 0, t["left"], -1),
                 "right": np.where(t["feat"] >= 0, t["right"], -1), "w": 1.0, "boosted": False,
                 **{c: t[c] for c in ("feat", "thr", "val", "cover")}} for t in model.trees]
    if isinstance(model, BoostedModel):
        return [{"left": np.where(t["feat"] >= 0, t["left"], -1),
                 "right": np.where(t["feat"] >= 0, t["right"], -1), "w": 1.0, "boosted": True,
                 "nan": -np.inf, "base": 0.0 if i else model.base, **{c: t[c] for c in ("feat", "thr", "val", "cover")}}
                for i, t in enumerate(model.trees)]
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    has_tree = "treeID" in data.columns
    rows = data.select(*(["treeID"] if has_tree else []), "nodeData.*").collect()
    boosted = isinstance(model, GBTClassificationModel)
    weights = list(model.treeWeights)
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"] if has_tree else 0, []).append(r)
    out = []
    for t in sorted(by_tree):
        nodes = sorted(by_tree[t], key=lambda r: r["id"])
        n = len(nodes)
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        feat = np.full(n, -1, np.int64)
        thr = np.zeros(n)
        val, cover = np.zeros(n), np.zeros(n)
        for r in nodes:
            i = r["id"]
            left[i], right[i] = r["leftChild"], r["rightChild"]
            if r["leftChild"] >= 0:
                feat[i] = r["split"]["featureIndex"]
                thr[i] = r["split"]["leftCategoriesOrThreshold"][0]
            stats = r["impurityStats"]
            cover[i] = sum(stats) if not boosted else stats[0]      # of a regression: count first
            if not boosted and stats is not None and len(stats) >= 2 and sum(stats) > 0:
                val[i] = stats[1] / sum(stats)  # class-1 share at the node
            else:
                val[i] = r["prediction"]
        out.append({"left": left, "right": right, "feat": feat, "thr": thr, "val": val, "cover": cover,
                    "w": float(weights[t]), "boosted": boosted})
    return out


def tree_contributions(df: DataFrame, trees: list[dict], features: list[str],
                       id_col: str = "tx_id") -> DataFrame:
    """X2, long: (id, feature, value, contribution, bias), contributions being path-
    dependent Tree SHAP values. bias + sum(contributions) = a forest's class-1
    probability, or a boosted model's margin. Rows need no shuffle."""
    import numpy as np

    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        shap, names = TreeShap(shared.value, len(features)), pa.array(features)
        for b in batches:
            x = _matrix(b.columns[1:])
            c = shap.contributions(x)
            at = np.tile(np.arange(len(features), dtype=np.int32), len(x))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(features))))
            yield pa.RecordBatch.from_arrays(
                [ids, names.take(pa.array(at)), pa.array(x.reshape(-1)), pa.array(c.reshape(-1)),
                 pa.array(np.full(len(at), shap.bias))],
                [id_col, "feature", "value", "contribution", "bias"])

    kind = df.schema[id_col].dataType.simpleString()
    return _doubles(df, features, id_col).mapInArrow(
        run, f"`{id_col}` {kind}, feature string, value double, contribution double, bias double")


def forest_contributions(df: DataFrame, trees: list[dict], features: list[str],
                         id_col: str = "tx_id") -> DataFrame:
    """Path attribution per row, cheaper than ``tree_contributions``: walking each tree, the change of the node's
    value is credited to the split feature. Invariant: bias + sum(contributions) =
    the forest's class-1 probability (averaged over trees), or the boosted model's
    margin (added over trees). Vectorized per Arrow batch in ``mapInPandas``."""
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(trees)
    nf = len(features)

    def run(batches):
        ts = bc.value
        total_w = sum(t["w"] for t in ts)
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            x = np.where(np.isnan(x), ts[0].get("nan", np.inf), x)
            m = len(pdf)
            contrib = np.zeros((m, nf))
            bias = np.zeros(m)
            rows = np.arange(m)
            for t in ts:
                node = np.zeros(m, dtype=np.int64)
                bias += t["w"] * t["val"][0] + t.get("base", 0.0)
                active = t["left"][node] >= 0
                while active.any():
                    idx = rows[active]
                    nd = node[idx]
                    f = t["feat"][nd]
                    go_left = x[idx, f] <= t["thr"][nd]
                    child = np.where(go_left, t["left"][nd], t["right"][nd])
                    np.add.at(contrib, (idx, f), t["w"] * (t["val"][child] - t["val"][nd]))
                    node[idx] = child
                    active = t["left"][node] >= 0
            if not ts[0]["boosted"]:
                contrib /= total_w
                bias /= total_w
            ids = np.repeat(pdf[id_col].to_numpy(), nf)
            yield pd.DataFrame({
                id_col: ids,
                "feature": np.tile(np.array(features, dtype=object), m),
                "value": x.reshape(-1),
                "contribution": contrib.reshape(-1),
                "bias": np.repeat(bias, nf),
            })

    schema = f"{id_col} long, feature string, value double, contribution double, bias double"
    return df.select(id_col, *[F.col(f).cast("double") for f in features]).mapInPandas(run, schema)
