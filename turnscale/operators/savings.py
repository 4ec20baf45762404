"""Prices, and what turns save by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscale.functions.text import normalize_model

RATES = ["input_per_m", "output_per_m", "cache_write_per_m", "cache_read_per_m"]
#: Rows up to which prices are broadcast; beyond, the planner chooses.
BROADCAST_ROWS = 100_000


def lookup_rates(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """turns with the RATES of their provider and model, null if there are none.

    prices has provider, model, RATES and origin ('live' or 'static'). In this order: live price of the exact model, live
    one of the model without its date, static ones likewise. Each distinct pair of the turns is looked up once.
    """
    pairs = turns.filter("provider is not null and model is not null").select("provider", "model").distinct()
    wanted = pairs.select("*", F.explode(F.array(F.struct(F.col("model").alias("name"), F.lit(0).alias("step")), F.struct(normalize_model(F.col("model")).alias("name"), F.lit(1).alias("step")))).alias("w"))
    priced = prices.withColumnRenamed("model", "name").withColumn("base", F.when(F.col("origin") == "live", 0).otherwise(2))
    found = wanted.select("provider", "model", "w.*").join(priced, ["provider", "name"])
    best = found.groupBy("provider", "model").agg(F.min_by(F.struct(*RATES), F.struct(F.col("base") + F.col("step"), "name")).alias("rates"))
    return turns.join(best, ["provider", "model"], "left").select(*turns.columns, *[F.col(f"rates.{r}").alias(r) for r in RATES])


def input_savings_usd(baseline: Column, actual: Column, per_m: Column) -> Column:
    return F.greatest(F.lit(0), baseline - actual) * per_m / F.lit(1e6)


def cache_savings_usd(tokens: Column, input_per_m: Column, cache_read_per_m: Column) -> Column:
    """0 without a price of cache reads."""
    return F.when(cache_read_per_m.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), tokens * input_per_m - tokens * cache_read_per_m) / F.lit(1e6))


def output_savings_usd(average: Column, actual: Column, per_m: Column) -> Column:
    """The average is rounded half to even."""
    return F.greatest(F.lit(0), F.bround(average, 0).cast("long") - actual) * per_m / F.lit(1e6)


def attach_cohort(turns: DataFrame, cohort: DataFrame) -> DataFrame:
    return turns.join(cohort.select("project_id", "baseline_avg_output_tokens"), "project_id", "left")


def turn_savings(turns: DataFrame, prices: DataFrame, cohort: DataFrame, places: int | None = 6) -> DataFrame:
    """turns with saved_{input,cache,output}_cost_usd to `places` (all, for None), and measurement_basis.

    Nothing is saved in a baseline period, nor without provider, model, input tokens or a price. The baseline of the
    input is the full repository's, else the naive retrieval's, else that without context. The last kind of saving that is
    above 0 names the basis, which is the input's by default.
    """
    money = ["saved_input_cost_usd", "saved_cache_cost_usd", "saved_output_cost_usd"]
    rows = attach_cohort(lookup_rates(turns.drop(*money, "measurement_basis"), prices), cohort)
    counts = ~F.coalesce("baseline_period", F.lit(False)) & F.col("actual_input_tokens").isNotNull() & F.col("input_per_m").isNotNull()
    baseline = F.coalesce("baseline_full_repo", "baseline_naive_rag", "baseline_no_context")
    tokens = F.col("actual_input_tokens")
    values = {
        money[0]: F.when(counts & F.col("injected") & baseline.isNotNull(), input_savings_usd(baseline, tokens, F.col("input_per_m"))),
        money[1]: F.when(counts & F.col("cache_hit_estimated") & (tokens > 0), cache_savings_usd(tokens, F.col("input_per_m"), F.col("cache_read_per_m"))),
        money[2]: F.when(counts & F.col("baseline_avg_output_tokens").isNotNull() & F.col("actual_output_tokens").isNotNull(), output_savings_usd(F.col("baseline_avg_output_tokens"), F.col("actual_output_tokens"), F.col("output_per_m"))),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()})
    basis = F.when(F.col(money[2]) > 0, "output_cohort_measured").when(F.col(money[1]) > 0, "cache_measured").otherwise("input_measured")
    rows = rows.withColumn("measurement_basis", basis)
    if places is not None:
        rows = rows.withColumns({m: F.round(m, places) for m in money})
    return rows.drop(*RATES, "baseline_avg_output_tokens")


def subscription_goal_usd(fx: DataFrame, cad: float = 15.0) -> DataFrame:
    """The price in US dollars, of (rate, date, source)."""
    return fx.select(F.round(F.lit(cad) / F.col("rate"), 2).alias("goal_usd"), "rate", "date", "source")
