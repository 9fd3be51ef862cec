"""Cache-versus-model cost model as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Default prices in milliseconds and dollars per call.
MODEL_MS, MODEL_USD, CACHE_MS, CACHE_USD = 500.0, 0.01, 1.0, 0.0


@dataclass(frozen=True)
class CostModel:
    """Prices of a stored answer and of a model call, as the formulas below need them."""

    cache_latency_ms: float = CACHE_MS
    cache_cost_usd: float = CACHE_USD
    llm_latency_ms: float = MODEL_MS
    llm_cost_usd: float = MODEL_USD

    @classmethod
    def from_best(cls, best, **prices) -> CostModel:
        """Prices with the search latency (median, ms) of a benchmark row such as ``best_config``
        gives; a row without one keeps the default latency."""
        latency = best["search_p50_ms"] if "search_p50_ms" in best else None
        return cls(cache_latency_ms=CACHE_MS if latency is None else float(latency), **prices)

    # --- B9 -------------------------------------------------------------------------
    def routing_cost(self, is_hit: Column) -> Column:
        hit_cost = self.cache_latency_ms + self.cache_cost_usd * 1000
        miss_cost = self.cache_latency_ms + self.llm_latency_ms + self.llm_cost_usd * 1000
        return F.when(is_hit, F.lit(float(hit_cost))).otherwise(F.lit(float(miss_cost)))

    def direct_llm_cost(self) -> Column:
        return F.lit(float(self.llm_latency_ms + self.llm_cost_usd * 1000))

    # --- B10 ------------------------------------------------------------------------
    def avg_latency(self, hit_rate: Column) -> Column:
        c, L = float(self.cache_latency_ms), float(self.llm_latency_ms)
        return hit_rate * F.lit(c) + (F.lit(1.0) - hit_rate) * F.lit(c + L)

    def latency_saving_pct(self, hit_rate: Column) -> Column:
        L = float(self.llm_latency_ms)
        if L <= 0:
            return F.lit(0.0)
        return F.round((F.lit(L) - self.avg_latency(hit_rate)) / F.lit(L) * F.lit(100.0), 2)

    def avg_cost_usd(self, hit_rate: Column) -> Column:
        return (F.lit(1.0) - hit_rate) * F.lit(float(self.llm_cost_usd))

    def monetary_saving_pct(self, hit_rate: Column) -> Column:
        U = float(self.llm_cost_usd)
        if U <= 0:
            return F.lit(0.0)
        return F.round((F.lit(U) - self.avg_cost_usd(hit_rate)) / F.lit(U) * F.lit(100.0), 2)

    def savings_columns(self, hit_rate: Column) -> list[Column]:
        return [
            self.avg_latency(hit_rate).alias("avg_latency_ms"),
            self.latency_saving_pct(hit_rate).alias("latency_saving_pct"),
            self.avg_cost_usd(hit_rate).alias("avg_cost_usd"),
            self.monetary_saving_pct(hit_rate).alias("monetary_saving_pct"),
        ]

    # SQL spellings for the oracles ------------------------------------------------------
    def sql_savings(self, h: str) -> str:
        c, L, U = float(self.cache_latency_ms), float(self.llm_latency_ms), float(self.llm_cost_usd)
        lat = f"({h} * {c!r}::DOUBLE + (1.0 - {h}) * {c + L!r}::DOUBLE)"
        lat_pct = f"round(({L!r}::DOUBLE - {lat}) / {L!r}::DOUBLE * 100.0, 2)" if L > 0 else "0.0"
        cost = f"((1.0 - {h}) * {U!r}::DOUBLE)"
        mon_pct = f"round(({U!r}::DOUBLE - {cost}) / {U!r}::DOUBLE * 100.0, 2)" if U > 0 else "0.0"
        return (f"{lat} AS avg_latency_ms, {lat_pct} AS latency_saving_pct, "
                f"{cost} AS avg_cost_usd, {mon_pct} AS monetary_saving_pct")
