"""Probability -> score -> level -> action, and the simulator's heuristic scorer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.functions.numeric import py_round
from txrisk.schema import ACTIONS, HEURISTIC_LEVEL_MIN_SCORE, LEVEL_MIN_SCORE, LEVELS


def clamp01(p: Column) -> Column:
    return F.least(F.greatest(p.cast("double"), F.lit(0.0)), F.lit(1.0))


def risk_score(p: Column) -> Column:
    """Clamp to [0, 1], x100, round half to even."""
    return F.rint(clamp01(p) * F.lit(100.0)).cast("int")


def risk_score_trunc(p: Column) -> Column:
    """Truncating variant: int(p * 100)."""
    return (p.cast("double") * F.lit(100.0)).cast("int")


def score_rank(score: Column, min_scores: dict | None = None) -> Column:
    """Level rank of an integer score in [0, 100] (clamped): the number of level
    minimums above LOW it reaches. One array lookup, so the score expression
    is referenced once."""
    ms = min_scores or LEVEL_MIN_SCORE
    mins = [ms["MEDIUM"], ms["HIGH"], ms["CRITICAL"]]
    table = [sum(s >= t for t in mins) for s in range(101)]
    idx = F.least(F.greatest(score.cast("int"), F.lit(0)), F.lit(100)) + 1
    return F.element_at(F.array(*[F.lit(r) for r in table]), idx)


def risk_level(score: Column, min_scores: dict | None = None) -> Column:
    return level_from_rank(score_rank(score, min_scores))


def level_rank(level: Column) -> Column:
    """LOW 0 < MEDIUM 1 < HIGH 2 < CRITICAL 3 (case-insensitive, unknown -> null)."""
    u = F.upper(level)
    expr = None
    for i, name in enumerate(LEVELS):
        expr = F.when(u == name, F.lit(i)) if expr is None else expr.when(u == name, F.lit(i))
    return expr


def _by_rank(rank: Column, values: list) -> Column:
    # one reference to rank: an array lookup instead of a CASE chain
    return F.element_at(F.array(*[F.lit(v) for v in values]), rank + 1)


def level_from_rank(rank: Column) -> Column:
    return _by_rank(rank, LEVELS)


def min_score_of_rank(rank: Column) -> Column:
    return _by_rank(rank, [LEVEL_MIN_SCORE[n] for n in LEVELS])


def action_of_rank(rank: Column) -> Column:
    return _by_rank(rank, [ACTIONS[n] for n in LEVELS])


def level_min_score(level: Column) -> Column:
    return min_score_of_rank(level_rank(level))


def recommended_action(level: Column) -> Column:
    u = F.upper(level)
    return (F.when(u == "CRITICAL", F.lit(ACTIONS["CRITICAL"]))
            .when(u == "HIGH", F.lit(ACTIONS["HIGH"]))
            .when(u == "MEDIUM", F.lit(ACTIONS["MEDIUM"]))
            .otherwise(F.lit(ACTIONS["LOW"])))


def score_probability(p: Column) -> Column:
    """RiskResult struct: probability, risk_score, risk_level, recommended_action."""
    s = risk_score(p)
    lvl = risk_level(s)
    return F.struct(p.cast("double").alias("probability"), s.alias("risk_score"),
                    lvl.alias("risk_level"), recommended_action(lvl).alias("recommended_action"))


def should_alert(level: Column, min_level: str = "MEDIUM") -> Column:
    return level_rank(level) >= F.lit(LEVELS.index(min_level.upper()))


# ---------------------------------------------------------------------------
# Heuristic (simulator) scorer
# ---------------------------------------------------------------------------

# Merchant, country and hour-band risk weights, their defaults and
# the term weights of the heuristic scorer.
MERCHANT_RISK = {
    "E-Commerce": 0.15,
    "Crypto Exchange": 0.72,
    "ATM Withdrawal": 0.45,
    "POS Retail": 0.08,
    "Wire Transfer": 0.55,
    "Gambling": 0.68,
    "Utility Bill": 0.04,
    "Travel Agency": 0.22,
}
COUNTRY_RISK = {
    "India": 0.10,
    "USA": 0.12,
    "Nigeria": 0.78,
    "Russia": 0.70,
    "UK": 0.14,
    "UAE": 0.35,
    "Brazil": 0.42,
    "Germany": 0.09,
    "China": 0.38,
    "Anonymous VPN": 0.90,
}
# (first hour, last hour inclusive, weight)
HOUR_BANDS = [(0, 3, 0.70), (4, 7, 0.20), (8, 17, 0.05), (18, 20, 0.15), (21, 23, 0.45)]
MERCHANT_DEFAULT, COUNTRY_DEFAULT, HOUR_DEFAULT = 0.20, 0.30, 0.10
TERM_WEIGHTS = {"merchant": 0.25, "country": 0.20, "hour": 0.15, "amount": 0.20,
                "signals": 0.12, "new_device": 0.05, "velocity": 0.03}
AMOUNT_SCALE = 100_000.0
SIGNAL_SCALE = 5.0
HIGH_RISK_COUNTRIES = ["Nigeria", "Russia", "Anonymous VPN"]
LARGE_AMOUNT = 50_000.0
RULE_BUMP = 5


def _map_lookup(key: Column, table: dict, default: float) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def hour_risk(hour: Column) -> Column:
    expr = None
    for lo, hi, w in HOUR_BANDS:
        cond = (hour >= lo) & (hour <= hi)
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr.otherwise(F.lit(HOUR_DEFAULT))


def heuristic_raw(amount: Column, merchant: Column, country: Column, hour: Column,
                  signals: Column, new_device: Column, velocity: Column,
                  jitter: Column | None = None) -> Column:
    """Weighted score clipped to [0, 1], before rounding. Jitter is off by
    default (pass e.g. ``F.randn(seed) * 0.02`` to turn it on)."""
    w = TERM_WEIGHTS
    s = _map_lookup(merchant, MERCHANT_RISK, MERCHANT_DEFAULT) * F.lit(w["merchant"])
    s = s + _map_lookup(country, COUNTRY_RISK, COUNTRY_DEFAULT) * F.lit(w["country"])
    s = s + hour_risk(hour) * F.lit(w["hour"])
    s = s + F.least(amount / F.lit(AMOUNT_SCALE), F.lit(1.0)) * F.lit(w["amount"])
    s = s + F.least(signals.cast("double") / F.lit(SIGNAL_SCALE), F.lit(1.0)) * F.lit(w["signals"])
    s = s + F.when(new_device, F.lit(w["new_device"])).otherwise(F.lit(0.0))
    s = s + F.when(velocity, F.lit(w["velocity"])).otherwise(F.lit(0.0))
    if jitter is not None:
        s = s + jitter
    return clamp01(s)


def heuristic_probability(raw: Column) -> Column:
    """Rounded to 4 places. Pass a column reference: the rounding reads its
    input several times."""
    return py_round(raw, 4)


def heuristic_level(score: Column) -> Column:
    return risk_level(score, HEURISTIC_LEVEL_MIN_SCORE)


def heuristic_reasons(amount: Column, country: Column, hour: Column, signals: Column,
                      velocity: Column) -> Column:
    """The simulator's five additive rules, in order (the signal rule prints the
    actual count)."""
    # fixed values: the reason texts
    return F.array_compact(F.array(
        F.when(signals >= 3, F.format_string(
            "Policy: Multiple suspicious signals detected (>=%d)", signals)),
        F.when(amount > F.lit(LARGE_AMOUNT),
               F.lit("Policy: Amount > sender balance + sender account emptied")),
        F.when(velocity, F.lit("Policy: High velocity flag triggered")),
        F.when(country.isin(*HIGH_RISK_COUNTRIES),
               F.concat(F.lit("Policy: High-risk country — "), country)),
        F.when((hour >= 0) & (hour <= 3),
               F.lit("Policy: Transaction in high-risk night window (00-04)")),
    ))
