"""Prices and statements to the model table: what was known about a company on each trading day."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.functions import vocabulary as V
from pitscore.functions.columns import period_key, period_of
from pitscore.operators.asof import asof_join, asof_join_by_period, component_theta_join, shifted_period_join
from pitscore.operators.rolling import price_features
from pitscore.operators.rows import keep_one, project
from pitscore.operators.series import add_target, with_target
from pitscore.operators.statements import statement_features

# The unknown company, the first day kept, and the days a statement takes to be published.
UNKNOWN_COMPANY = "00000000000000"
HISTORY_START = "2011-03-31"
PUBLICATION_DAYS = 90

SERIES = ["id_cnpj", "ticker"]


def known_prices(prices: DataFrame, since: str | None) -> DataFrame:
    """Rows of known companies after the first day kept (None: all days); both tests reach the scan."""
    known = prices.filter((F.col("id_cnpj") != UNKNOWN_COMPANY) & F.col("date").isNotNull())
    return known if since is None else known.filter(F.col("date") > F.lit(since).cast("date"))


def with_calendar(prices: DataFrame) -> DataFrame:
    return prices.select(
        "*",
        F.year("date").alias("dt_year"),
        F.month("date").alias("dt_month"),
        period_of("date", PUBLICATION_DAYS).alias("dt_safra_dre"),
    )


def prepare_prices(prices: DataFrame, since: str | None = HISTORY_START) -> DataFrame:
    """One row per (date, id_cnpj, ticker) with calendar columns and the lagged statement period."""
    return with_calendar(keep_one(known_prices(prices, since), ["date", *SERIES]))


def prepare_statements(statements: DataFrame) -> DataFrame:
    """One row per (id_cnpj, dt_refer), the last processed; adds the statement's period ``_safra`` and
    ``_visible``, the first day a price row may use it."""
    order = [F.col("processed_at").desc_nulls_last()] if "processed_at" in statements.columns else []
    one = keep_one(statements.filter(F.col("dt_refer").isNotNull()), ["id_cnpj", "dt_refer"], order)
    month = F.month("dt_refer")
    return one.select(
        "*",
        period_key("dt_year", month).alias("_safra"),
        F.date_add(F.make_date("dt_year", month, F.lit(1)), PUBLICATION_DAYS).alias("_visible"),
    ).drop("dt_year", "dt_quarter")


def join_statements(
    prices: DataFrame, statements: DataFrame, by_period: bool = False, keys_from: DataFrame | None = None,
    within_range: bool = False, packed: str | None = None,
) -> DataFrame:
    """Left as-of join of prepared prices to prepared statements; the latest statement wins.

    A price row sees a statement when its ``dt_safra_dre`` is at or after ``_safra``, which is the same as
    its date being at or after ``_visible``. Ordering by date keeps the rows sorted for the lags.
    ``within_range`` copies statements only to tickers traded while they are the latest. ``packed`` names a
    struct that keeps the statement's columns together (not with ``by_period``).
    """
    payload = [c for c in statements.columns if c not in ("id_cnpj", "_safra", "_visible")]
    if by_period:
        return asof_join_by_period(
            prices, statements, ["id_cnpj"], "dt_safra_dre", "_safra", ["dt_refer"], payload, keys_from, keyed=True
        )
    return asof_join(
        prices, statements, ["id_cnpj"], SERIES, "date", "_visible", ["dt_refer"], payload, keys_from, True,
        within_range, packed,
    )


def build_model_table(
    prices: DataFrame,
    statements: DataFrame,
    columns: Sequence[str] | None = None,
    since: str = HISTORY_START,
    shift: int = 1,
    drop_unmatched: bool = True,
    features: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """As-of join, lagged percentage-change target, and the final filter on a known company.

    The filter stays after the lags, so a price row without a statement still serves as a lag. ``features``
    adds columns over whole series, the days up to ``since`` among them; it gets the joined rows, so it finds
    them shuffled and sorted, and the features are never shuffled themselves.
    """
    first = since if features is None else None
    records = prepare_statements(statements)
    if columns is not None:  # what nobody asked for is not carried
        asked = {*columns, "id_cnpj", "dt_refer", "txt_company_name", "_safra", "_visible"}
        records = records.select(*[c for c in records.columns if c in asked])
    joined = join_statements(prepare_prices(prices, first), records, keys_from=known_prices(prices, first))
    if features is not None:
        joined = features(joined).filter(F.col("date") > F.lit(since).cast("date"))
    out = add_target(joined, SERIES, "date", "adj_close", shift)
    if columns is not None:
        out = project(out, columns)
    return out.filter(F.col("txt_company_name").isNotNull()) if drop_unmatched else out


def build_full_model_table(
    prices: DataFrame,
    statements: DataFrame,
    since: str = HISTORY_START,
    shift: int = 1,
    drop_unmatched: bool = True,
) -> DataFrame:
    """The whole model table, 250 columns in their order, from raw prices and statements.

    Both inputs are deduplicated before any feature is computed, so no window sees a row twice. Statements are
    joined first: only bare price rows are shuffled, and their features are computed where the join left them. Targets
    come before the features, whose step hides from Spark that the rows are sorted; rows without one go after it.
    A statement travels as one struct and is taken apart last, so that no step between handles its columns one by one.
    """
    records = statement_features(prepare_statements(statements), ["id_cnpj"], "dt_refer")
    priced = known_prices(prices, since)
    rows = join_statements(prepare_prices(prices, since), records, keys_from=priced, packed="_statement")
    joined = price_features(with_target(rows, SERIES, "date", "adj_close", shift), SERIES, ["date"])
    flagged = joined.filter(F.col("cat_target").isNotNull())
    stated = [F.col("_statement")[c].alias(c) for c in V.model_columns() if c not in joined.columns]
    out = project(flagged.select(*joined.columns, *stated), V.model_columns())
    return out.filter(F.col("txt_company_name").isNotNull()) if drop_unmatched else out


def build_shifted_model_table(
    prices: DataFrame, statements: DataFrame, since: str = HISTORY_START, shift: int = 1
) -> DataFrame:
    """Older variant: statements matched to their own date 180 days back, then joined to prices whose
    year and month are each at or after the statement's."""
    order = [F.col("processed_at").desc_nulls_last()] if "processed_at" in statements.columns else []
    dated = statements.filter(F.col("dt_refer").isNotNull()).withColumn("dt_month", F.month("dt_refer"))
    one = keep_one(dated, ["id_cnpj", "dt_refer"], order)
    shifted = shifted_period_join(one, ["id_cnpj"], "dt_refer", "dt_year", "dt_month")
    records = shifted.withColumnsRenamed({"dt_year": "_year", "dt_month": "_month"})
    payload = [c for c in records.columns if c not in ("id_cnpj", "_year", "_month", "dt_quarter")]
    rows = prepare_prices(prices, since).drop("dt_safra_dre")
    joined = component_theta_join(
        rows,
        records,
        ["id_cnpj"],
        "dt_year",
        "dt_month",
        "_year",
        "_month",
        ["dt_refer"],
        payload,
        keys_from=with_calendar(known_prices(prices, since)),
    )
    return add_target(joined, SERIES, "date", "adj_close", shift)
