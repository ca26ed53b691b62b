"""Cost, privacy and break-even economics (M11-M16) as column arithmetic.

Lookup tables are tiny fixed maps, applied with ``create_map`` lookups (no join at all)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.config import (
    GPU_COST_PER_HOUR,
    LLM_API_COSTS,
    PRIVACY_DEFAULT,
    PRIVACY_RISK,
    TOKEN_BUDGETS,
)

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def token_budget(task, budgets: dict = TOKEN_BUDGETS) -> Column:
    return F.try_element_at(_lit_map(budgets), _c(task))


def throughput(latency_ms, task=None, budget=None, budgets: dict = TOKEN_BUDGETS) -> Column:
    """Estimated tokens/s = token budget of the task / mean latency in seconds."""
    b = _c(budget) if budget is not None else token_budget(task, budgets)
    return F.try_divide(b.cast("double"), _c(latency_ms) / 1000.0)


def slm_cost_per_1m(tokens_per_second, gpu_cost_per_hour: float = GPU_COST_PER_HOUR,
                    decimals: int | None = 4) -> Column:
    """Self-hosted USD per 1M tokens = gpu_per_hour / (tps * 3600) * 1e6."""
    v = F.try_divide(F.lit(float(gpu_cost_per_hour)), _c(tokens_per_second) * 3600.0) * 1e6
    return F.round(v, decimals) if decimals is not None else v


def training_cost(hours, gpu_cost_per_hour: float = GPU_COST_PER_HOUR, decimals: int | None = 2) -> Column:
    """Training hours x GPU price."""
    v = _c(hours) * float(gpu_cost_per_hour)
    return F.round(v, decimals) if decimals is not None else v


def roi_breakeven(fine_tuning_cost, api_cost, slm_cost) -> Column:
    """Tokens at which fine-tuning pays off, rounded to a unit; +inf when the SLM saves
    nothing per token.  The ``when`` guards the division (ANSI mode raises on x/0)."""
    saving = _c(api_cost) - _c(slm_cost)
    return F.when(saving <= 0, F.lit(INF)).otherwise(F.round(_c(fine_tuning_cost) / saving * 1e6, 0))


def privacy_risk(deployment_type, table: dict = PRIVACY_RISK, default: str = PRIVACY_DEFAULT) -> Column:
    """Privacy level of a deployment type, ``unknown`` otherwise."""
    return F.coalesce(F.try_element_at(_lit_map(table), _c(deployment_type)), F.lit(default))


def api_price(model, kind: str = "blended", prices: dict = LLM_API_COSTS) -> Column:
    """API price per 1M tokens (input / output / blended); NULL for unknown models."""
    return F.try_element_at(_lit_map({m: float(p[kind]) for m, p in prices.items()}), _c(model))
