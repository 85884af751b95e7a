"""Declarative policy rules: each rule is (predicate, minimum level, reason).

The rule list is plain data, so a caller may pass its own. A rule set folds
into two expressions: the highest minimum level among the rules that fire and
the ordered array of their reasons.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.schema import LEVELS


def _f(name: str) -> Column:
    # a missing feature counts as 0
    return F.coalesce(F.col(name), F.lit(0))


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Callable[[], Column]
    min_level: str
    reason: str


# The rule order, levels and reason texts.
DEFAULT_RULES = [
    Rule("amount_over_balance_emptied",
         lambda: (_f("amount_to_oldbalance_orig_ratio") > 1) & (_f("sender_account_emptied") == 1),
         "HIGH", "Policy: Amount > sender balance + sender account emptied"),
    Rule("multiple_signals",
         lambda: _f("suspicious_signal_count") >= 3,
         "MEDIUM", "Policy: Multiple suspicious signals detected (>=3)"),
    Rule("very_many_signals",
         lambda: _f("suspicious_signal_count") >= 5,
         "CRITICAL", "Policy: Very high suspicious signal count (>=5)"),
    Rule("large_to_fresh_destination",
         lambda: (_f("is_large_transaction") == 1) & (_f("dest_received_large_amount") == 1),
         "HIGH", "Policy: Large transaction + destination started from zero balance"),
]


def policy_min_rank(rules=DEFAULT_RULES) -> Column:
    ranks = [F.when(r.predicate(), F.lit(LEVELS.index(r.min_level))).otherwise(F.lit(0))
             for r in rules]
    return F.greatest(F.lit(0), *ranks)


def policy_reasons(rules=DEFAULT_RULES) -> Column:
    return F.array_compact(F.array(*[F.when(r.predicate(), F.lit(r.reason)) for r in rules]))
