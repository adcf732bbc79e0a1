from pitscore.functions.columns import (
    count_if,
    hash_permille,
    in_months,
    missing,
    period_key,
    period_of,
    relative_change,
    share_pct,
    sign_flag,
)

__all__ = [
    "count_if",
    "hash_permille",
    "in_months",
    "missing",
    "period_key",
    "period_of",
    "relative_change",
    "share_pct",
    "sign_flag",
]
