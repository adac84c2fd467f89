"""The scalar functions for SQL users: session-scoped SQL functions, inlined by the optimizer like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, result, body)
FUNCTIONS = {
    "implied_prob": ("price DOUBLE", "DOUBLE", "CASE WHEN isnan(price) OR price = 0 OR abs(price) = double('infinity') THEN NULL WHEN price < 0 THEN -price / (-price + 100.0D) WHEN price > 0 THEN 100.0D / (price + 100.0D) END"),
    "decimal_price": ("price DOUBLE", "DOUBLE", "1.0D / implied_prob(price)"),
    "fair_over": ("o DOUBLE, u DOUBLE", "DOUBLE", "CASE WHEN implied_prob(o) + implied_prob(u) > 0 THEN implied_prob(o) / (implied_prob(o) + implied_prob(u)) END"),
    "log_odds": ("p DOUBLE", "DOUBLE", "ln(least(greatest(p, 1e-6D), 1 - 1e-6D)) - ln(1 - least(greatest(p, 1e-6D), 1 - 1e-6D))"),
    "inverse_log_odds": ("z DOUBLE", "DOUBLE", "1.0D / (1.0D + exp(-z))"),
    "platt_map": ("p DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", "inverse_log_odds(a + b * log_odds(p))"),
    "shrunk_rate": ("k DOUBLE, n DOUBLE, prior DOUBLE, pseudo DOUBLE", "DOUBLE", "(k + pseudo * prior) / (n + pseudo)"),
    "line_text": ("stem STRING, line DOUBLE", "STRING", "concat(stem, ' > ', cast(line AS STRING))"),
    "line_number": ("market STRING", "DOUBLE", "try_cast(trim(element_at(split(market, '>'), -1)) AS DOUBLE)"),
}


def register(spark: SparkSession) -> None:
    """Create or replace all functions in the session."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        # a NULL in any argument of least/greatest would be skipped, so the log odds of NULL are kept NULL here
        guard = f"CASE WHEN p IS NOT NULL THEN {body} END" if name == "log_odds" else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {guard}")
