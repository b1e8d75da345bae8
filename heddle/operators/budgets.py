"""Memory budgets: bytes to tokens to compression ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal units (fixed values).
UNITS = {"MB": 10**6, "GB": 10**9}


def bytes_per_token(layers: int, kv_heads: int, head_dim: int, element_bytes: int, batch: int = 1) -> int:
    return layers * 2 * kv_heads * head_dim * element_bytes * batch


def token_budget(budget: float, unit: str, per_token: int) -> int:
    """Whole tokens that fit; an error for budgets that are not positive, unknown units, or less than one token."""
    if budget <= 0:
        raise ValueError("the memory budget must be positive")
    if unit not in UNITS:
        raise ValueError(f"the unit must be one of {sorted(UNITS)}")
    tokens = int(budget * UNITS[unit]) // per_token
    if tokens < 1:
        raise ValueError("the memory budget is less than one token")
    return tokens


def ratio_for(length: int, tokens: int) -> tuple[int, float]:
    """Retained tokens and compression ratio of a context."""
    retained = min(length, tokens)
    return retained, 1.0 - retained / length


def decode_target(total_seen: int, cached: int, ratio: float) -> tuple[int, float]:
    """Target size from logical positions, and the ratio that takes a cache of that length there."""
    target = max(1, math.floor(total_seen * (1 - ratio)))
    return target, max(0.0, 1.0 - target / cached)


def budget_columns(contexts: DataFrame, length: Column, per_token: int, tokens: int | None = None, ratio: float = 0.0) -> DataFrame:
    """contexts with retained_tokens, compression_ratio, original_bytes, retained_bytes, original_mb, retained_mb."""
    retained = F.least(length, F.lit(tokens)) if tokens is not None else F.greatest(F.lit(1), F.floor(length * F.lit(1.0 - ratio)))
    out = contexts.withColumn("retained_tokens", retained.cast("long"))
    share = F.lit(1.0) - F.col("retained_tokens") / F.greatest(length, F.lit(1)) if tokens is not None else F.lit(float(ratio))
    return out.withColumns(
        {
            "compression_ratio": share,
            "original_bytes": (length * per_token).cast("long"),
            "retained_bytes": F.col("retained_tokens") * per_token,
            "original_mb": length * per_token / F.lit(1e6),
            "retained_mb": F.col("retained_tokens") * per_token / F.lit(1e6),
        }
    )
