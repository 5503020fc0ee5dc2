"""Life of an induction's statistics: checks, improvement, display; and statistics of repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown_perplexity(p: Column) -> Column:
    """As people read it: two digits, scientific from a million on, and a sign for what is not finite."""
    power = F.floor(F.log10(p)).cast("int")
    digits = F.format_string("%.2fe+%02d", p / F.pow(F.lit(10.0), power), power)
    return F.when(F.isnan(p) | (F.abs(p) == float("inf")), "∞").when(p >= 1e6, digits).otherwise(F.format_string("%.2f", p))


def improvement(stats: DataFrame) -> DataFrame:
    """stats (baseline_ppl, final_ppl, oov_rate) with the improvement, its percentage (0 without a baseline), perfect coverage and what is shown."""
    gain = F.col("baseline_ppl") - F.col("final_ppl")
    return stats.withColumns({
        "improvement": gain,
        "improvement_percent": F.when(F.col("baseline_ppl") == 0, 0.0).otherwise(100 * gain / F.nullif("baseline_ppl", F.lit(0.0))),
        "perfect": F.col("oov_rate") == 0,
        "shown": F.concat(shown_perplexity(F.col("baseline_ppl")), F.lit(" -> "), shown_perplexity(F.col("final_ppl")), F.lit(", OOV "), F.format_string("%.4f%%", F.col("oov_rate") * 100)),
    })


def faults(stats: dict) -> list[str]:
    """What is wrong with the statistics of an induction; nothing if they are sound."""
    rules = {
        "total_pieces": lambda x: isinstance(x, int) and x >= 0,
        "baseline_ppl": lambda x: isinstance(x, (int, float)) and x > 0,
        "final_ppl": lambda x: isinstance(x, (int, float)) and x > 0,
        "oov_rate": lambda x: isinstance(x, (int, float)) and 0 <= x <= 1,
        "em_iterations": lambda x: isinstance(x, int) and x >= 0,
        "pruned_pieces": lambda x: isinstance(x, int) and x >= 0,
    }
    return [f"{k}: missing" if k not in stats else f"{k}: {stats[k]!r}" for k, good in rules.items() if k not in stats or not good(stats[k])]


def run_stats(runs: DataFrame, key: str, seconds: str) -> DataFrame:
    """key, n, mean, std (of a sample; 0 of one run), min, max."""
    r = lambda c, name: F.round(c, 6).alias(name)
    return runs.groupBy(key).agg(F.count("*").alias("n"), r(F.avg(seconds), "mean"), r(F.coalesce(F.stddev_samp(seconds), F.lit(0.0)), "std"), r(F.min(seconds), "min"), r(F.max(seconds), "max"))
