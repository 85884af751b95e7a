"""Per-transaction feature expressions (all Catalyst, one projection)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.functions.numeric import safe_div
from txrisk.schema import TYPE_ENCODING, TYPE_RISK, UNKNOWN_TYPE_CODE, UNKNOWN_TYPE_RISK


def _lookup(key: Column, table: dict, default) -> Column:
    expr = None
    for k, v in table.items():
        expr = (F.when(key == F.lit(k), F.lit(v)) if expr is None
                else expr.when(key == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def normalized_type(col: str = "type") -> Column:
    return F.upper(F.col(col))


def type_encoded(col: str = "type") -> Column:
    return _lookup(normalized_type(col), TYPE_ENCODING, UNKNOWN_TYPE_CODE)


def type_risk_score(col: str = "type") -> Column:
    return _lookup(normalized_type(col), TYPE_RISK, UNKNOWN_TYPE_RISK)


def type_decode(code_col: str = "type_encoded") -> Column:
    """Inverse of the fixed type codes; anything else decodes to TRANSFER."""
    inv = {v: k for k, v in TYPE_ENCODING.items()}
    return _lookup(F.col(code_col), inv, "TRANSFER")


def step_bucket(step: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin (e[i], e[i+1]] holding ``step``; the lowest
    edge itself falls in bin 0. Outside [e0, e_last] -> null."""
    x = step.cast("double")
    expr = F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[1])), F.lit(0))
    for i in range(1, len(edges) - 1):
        expr = expr.when((x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1])), F.lit(i))
    return expr


def feature_columns(p95: float, median_dest: float, edges: list[float],
                    median_steps: float, counts_col: str = "_n_step") -> list[Column]:
    """All derived features from the raw columns (and the joined step count)."""
    amount = F.col("amount")
    old_o, new_o = F.col("oldbalanceOrg"), F.col("newbalanceOrig")
    old_d, new_d = F.col("oldbalanceDest"), F.col("newbalanceDest")
    bool_int = lambda c: c.cast("int")

    expected_o = old_o - amount
    error_o = new_o - expected_o
    expected_d = old_d + amount
    error_d = new_d - expected_d
    ratio_o = safe_div(amount, old_o)
    ratio_d = safe_div(amount, old_d)
    emptied = bool_int((old_o > 0) & (new_o == 0))
    dest_from_zero = bool_int((old_d == 0) & (new_d > 0))
    large = bool_int(amount > F.lit(p95))
    in_step = F.coalesce(F.col(counts_col), F.lit(0).cast("long"))
    signals = (emptied + large + dest_from_zero
               + bool_int(F.abs(error_o) > 0) + bool_int(F.abs(error_d) > 0)
               + bool_int(ratio_o > 1))
    return [
        type_encoded().alias("type_encoded"),
        type_risk_score().alias("type_risk_score"),
        bool_int(old_o == 0).alias("is_oldbalanceOrg_zero"),
        bool_int(new_o == 0).alias("is_newbalanceOrig_zero"),
        bool_int(old_d == 0).alias("is_oldbalanceDest_zero"),
        bool_int(new_d == 0).alias("is_newbalanceDest_zero"),
        F.log1p(amount).alias("log_amount"),
        (new_o - old_o).alias("balance_change_orig"),
        expected_o.alias("expected_balance_change_orig"),
        error_o.alias("balance_error_orig"),
        (new_d - old_d).alias("balance_change_dest"),
        expected_d.alias("expected_balance_change_dest"),
        error_d.alias("balance_error_dest"),
        ratio_o.alias("amount_to_oldbalance_orig_ratio"),
        ratio_d.alias("amount_to_oldbalance_dest_ratio"),
        emptied.alias("sender_account_emptied"),
        dest_from_zero.alias("dest_received_large_amount"),
        large.alias("is_large_transaction"),
        step_bucket(F.col("step"), edges).alias("step_bucket"),
        in_step.alias("transactions_in_step"),
        bool_int(in_step > F.lit(median_steps)).alias("is_high_velocity_step"),
        bool_int(old_d > F.lit(median_dest)).alias("is_dest_high_balance"),
        signals.alias("suspicious_signal_count"),
    ]
