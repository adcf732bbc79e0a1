"""Column names of the model table, built by rule.

Names carry meaning: ``id_`` key, ``dt_`` date, ``txt_`` text, ``amt_`` amount, ``pct_`` ratio,
``cat_`` flag; a trailing number is a window length.
"""

from __future__ import annotations

# Column names and window lengths users of the model table rely on.
ID_COLUMNS = [
    "id_cnpj", "id_cvm", "txt_company_name", "ticker", "id_isin", "processed_at", "date", "dt_refer",
    "dt_year", "dt_month", "dt_safra_dre", "dt_fim_exerc", "dt_ini_exerc", "cat_target", "var_target",
]
STATEMENT_AMOUNTS = [
    "amt_cost_goods_and_services",
    "amt_earnings_before_income_tax_and_social_contribution",
    "amt_earnings_before_interest_and_taxes",
    "amt_financial_results",
    "amt_groos_revenue",
    "amt_net_profit",
    "amt_operating_revenues_and_expenses",
    "amt_sales_revenue",
]
TRACKED_AMOUNTS = [
    "amt_sales_revenue",
    "amt_cost_goods_and_services",
    "amt_earnings_before_interest_and_taxes",
    "amt_financial_results",
    "amt_net_profit",
]
AMPLITUDE = "amplitude_close_high_price"
ROLLING_WINDOWS = [5, 10, 15, 20, 25, 30, 60, 90, 120, 160, 180, 360]
CHANGE_COLUMNS = ["adj_close", "high_price", "low_price", AMPLITUDE]
SLOPE_WINDOWS = [11, 16, 21, 26, 31, 61, 91, 121, 161, 181, 361]
BREAK_WINDOWS = [5, 10, 15, 20, 25, 30, 60, 90, 120]
BREAK_HIGH_COLUMNS = ["adj_close", "high_price"]
BREAK_LOW_COLUMNS = ["adj_close", "low_price"]
STRENGTH_WINDOWS = [10, 15, 20, 25, 30, 60, 90, 120]
STATEMENT_WINDOWS = [1, 2, 3, 4]
STATEMENT_SLOPE_WINDOWS = [3, 6, 12]
STATEMENT_LAGS = {"1m": 1, "1y": 12}


def price_feature_columns() -> list[str]:
    names = [AMPLITUDE]
    names += [f"amt_{s}_adj_close_{n}" for n in ROLLING_WINDOWS for s in ("avg", "std", "min", "max")]
    names += [f"pct_tx_{c}_{n}d" for c in CHANGE_COLUMNS for n in ROLLING_WINDOWS]
    names += [f"amt_beta_adj_close_{n}" for n in SLOPE_WINDOWS]
    names += [f"cat_{c}_broke_high_{n}" for c in BREAK_HIGH_COLUMNS for n in BREAK_WINDOWS]
    names += [f"cat_{c}_broke_low_{n}" for n in BREAK_WINDOWS for c in BREAK_LOW_COLUMNS]
    names += [f"amt_IFR_adj_close_{n}" for n in STRENGTH_WINDOWS]
    return names


def statement_feature_columns() -> list[str]:
    names = list(STATEMENT_AMOUNTS)
    names += [f"amt_tot_{a}_{lag}_lag" for a in TRACKED_AMOUNTS for lag in STATEMENT_LAGS]
    names += [f"pct_tx_{a}_{lag}" for a in TRACKED_AMOUNTS for lag in STATEMENT_LAGS]
    names += [f"amt_{s}_{a}_{n}" for s in ("avg", "std") for a in TRACKED_AMOUNTS for n in STATEMENT_WINDOWS]
    names += [f"amt_beta_{a}_{n}" for n in STATEMENT_SLOPE_WINDOWS for a in TRACKED_AMOUNTS]
    return names


def model_columns() -> list[str]:
    """The model table's columns in order: identifiers and target, price and statement features."""
    return ID_COLUMNS + price_feature_columns() + statement_feature_columns()


def non_features() -> list[str]:
    """Columns a model must not see; every other column of the model table is a feature."""
    return ID_COLUMNS + [AMPLITUDE]
