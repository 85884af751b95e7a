"""Scoring pipeline: probability -> risk -> policy -> alert -> audit record.

Every step is a projection over the feature frame, so a batch, a micro-batch
and a single request run the same plan, shuffle-free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scoring as S
from txrisk.functions.policy import DEFAULT_RULES, policy_min_rank, policy_reasons

ALERT_STATUS = "PENDING_REVIEW"
ALERT_PREFIX = "ALT"


def score(df: DataFrame, prob_col: str = "prob", rules=DEFAULT_RULES) -> DataFrame:
    """Adds ml_* columns from the probability and the policy-adjusted final_* ones."""
    p = F.col(prob_col).cast("double")
    out = (df.withColumns({"ml_probability": p, "ml_risk_score": S.risk_score(p)})
           .withColumn("_ml_rank", S.score_rank(F.col("ml_risk_score")))
           .withColumns({"_final_rank": F.greatest(F.col("_ml_rank"), policy_min_rank(rules)),
                         "policy_reasons": policy_reasons(rules)}))
    return out.withColumns({
        "ml_risk_level": S.level_from_rank(F.col("_ml_rank")),
        "ml_action": S.action_of_rank(F.col("_ml_rank")),
        "final_risk_level": S.level_from_rank(F.col("_final_rank")),
        "final_risk_score": F.greatest(F.col("ml_risk_score"),
                                       S.min_score_of_rank(F.col("_final_rank"))),
        "final_action": S.action_of_rank(F.col("_final_rank")),
        "policy_override_applied": (F.col("_final_rank") != F.col("_ml_rank")).cast("int"),
    }).drop("_ml_rank", "_final_rank")


def alert_struct(id_col: str = "tx_id", ts_col: str = "created_at",
                 min_level: str = "MEDIUM") -> F.Column:
    """Alert for rows at or above min_level, else null. The id carries the
    transaction key so ids never collide inside a batch."""
    ts = F.col(ts_col)
    alert = F.struct(
        F.concat_ws("-", F.lit(ALERT_PREFIX), F.date_format(ts, "yyyyMMddHHmmss"),
                    F.col(id_col).cast("string")).alias("alert_id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"),
        F.col(id_col).cast("string").alias("transaction_ref"),
        F.col("final_risk_level").alias("risk_level"),
        F.col("final_risk_score").alias("risk_score"),
        F.col("ml_probability").alias("probability"),
        F.col("final_action").alias("recommended_action"),
        F.transform("policy_reasons", lambda r: F.struct(r.alias("reason"))).alias("reasons"),
        F.lit(ALERT_STATUS).alias("status"),
    )
    return F.when(S.should_alert(F.col("final_risk_level"), min_level), alert)


def with_alerts(scored: DataFrame, min_level: str = "MEDIUM") -> DataFrame:
    return scored.withColumn("alert", alert_struct(min_level=min_level))


def audit_records(scored: DataFrame) -> DataFrame:
    """The prediction-log row for each scored transaction."""
    return scored.select(
        F.col("tx_id").alias("id"),
        F.col("created_at"),
        F.struct(*[F.col(c) for c in ("step", "type", "amount", "oldbalanceOrg", "newbalanceOrig",
                                      "oldbalanceDest", "newbalanceDest")]).alias("transaction"),
        "ml_probability", "ml_risk_level", "ml_risk_score",
        "final_risk_level", "final_risk_score", "policy_override_applied",
        "policy_reasons",
        F.col("suspicious_signal_count").cast("int").alias("suspicious_signal_count"),
        alert_struct().alias("alert"),
    )


def score_heuristic(events: DataFrame) -> DataFrame:
    """The simulator's weighted scorer and its additive rules over events."""
    raw = S.heuristic_raw(F.col("amount"), F.col("merchant_type"), F.col("country"),
                          F.col("hour"), F.col("suspicious_signals"),
                          F.col("is_new_device"), F.col("velocity_flag"))
    reasons = S.heuristic_reasons(F.col("amount"), F.col("country"), F.col("hour"),
                                  F.col("suspicious_signals"), F.col("velocity_flag"))
    base = S.risk_score_trunc(F.col("ml_probability"))
    n = F.size(F.col("policy_reasons"))
    # base <= 100, so with no reason this is base itself
    final = F.least(F.lit(100), base + n * F.lit(S.RULE_BUMP))
    return (events.withColumn("_raw", raw)
            .withColumn("ml_probability", S.heuristic_probability(F.col("_raw"))).drop("_raw")
            .withColumn("policy_reasons", reasons)
            .withColumns({
                "ml_risk_level": S.heuristic_level(base),
                "final_risk_score": final,
                "policy_override_applied": (n > 0).cast("int"),
            })
            .withColumn("final_risk_level", S.heuristic_level(F.col("final_risk_score"))))
