"""The turn contract: what a turn request must have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: required fields, the enumeration, least values.
REQUIRED = ["session_id", "turn_id", "project_id", "provider", "actual_input_tokens", "tokens_estimated", "block_hash", "injected"]
PROVIDERS = ["openai", "anthropic", "ollama", "vscode_extension"]
LEAST = {"turn_id": 1}
FIELDS = [
    *REQUIRED, "user_id", "model", "actual_output_tokens", "baseline_full_repo", "baseline_naive_rag", "baseline_no_context", "incomplete",
    "latency_ms_total", "latency_ms_ttft", "cache_eligible", "cache_hit_estimated",
]


def validate_contract(turns: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Rows that break the contract, as (id, violations); columns beyond `known` are violations of every row that has them."""
    checks = [F.when(F.col(c).isNull(), f"missing:{c}") for c in REQUIRED if c in turns.columns]
    checks += [F.lit(f"missing:{c}") for c in REQUIRED if c not in turns.columns]
    checks.append(F.when(F.col("provider").isNotNull() & ~F.col("provider").isin(PROVIDERS), "enum:provider"))
    checks += [F.when(F.col(c) < n, f"minimum:{c}") for c, n in LEAST.items() if c in turns.columns]
    checks += [F.when(F.col(f"`{c}`").isNotNull(), f"unknown:{c}") for c in turns.columns if known and c not in known]
    return turns.select("id", F.array_compact(F.array(*checks)).alias("violations")).filter(F.size("violations") > 0)
