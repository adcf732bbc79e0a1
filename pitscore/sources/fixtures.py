"""Panels with the shapes of the real inputs, derived from the shared benchmark tables.

Prices and amounts are whole numbers, so sums are exact and two engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _company(c: str):
    return F.lpad(F.col(c).cast("string"), 14, "0")


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: a price panel before deduplication."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        _company("l_suppkey").alias("id_cnpj"),
        F.col("l_returnflag").alias("ticker"),
        F.floor("l_extendedprice").cast("double").alias("adj_close"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("close"),
        F.floor(F.col("l_extendedprice") * (1 + F.col("l_tax"))).cast("double").alias("high_price"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount") - F.col("l_tax")))
        .cast("double")
        .alias("low_price"),
        F.col("l_quantity").alias("volume"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel, one row per (date, id_cnpj, ticker)."""
    return (
        raw_prices(spark, sf_dir)
        .groupBy("date", "id_cnpj", "ticker")
        .agg(
            F.max("adj_close").alias("adj_close"),
            F.max("close").alias("close"),
            F.max("high_price").alias("high_price"),
            F.min("low_price").alias("low_price"),
            F.sum("volume").alias("volume"),
        )
        .withColumn("id_isin", F.concat(F.lit("BR"), "id_cnpj", "ticker"))
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement panel, one row per (id_cnpj, quarter end); company names come from suppliers."""
    price = F.col("l_extendedprice")
    disc, tax, qty = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")

    def whole(c):
        return F.floor(F.max(c)).cast("double")

    panel = (
        table(spark, sf_dir, "lineitem")
        .withColumn("q", F.trunc(F.to_date("l_shipdate"), "quarter"))
        .groupBy("l_suppkey", "q")
        .agg(
            F.to_date(F.max("l_shipdate")).alias("dt_last"),
            whole(price * disc).alias("amt_cost_goods_and_services"),
            whole(price * (1 - tax)).alias("amt_earnings_before_income_tax_and_social_contribution"),
            whole(price * (1 - disc)).alias("amt_earnings_before_interest_and_taxes"),
            (F.floor(F.min(price * tax)) - 50).cast("double").alias("amt_financial_results"),
            whole(price * (1 + tax)).alias("amt_groos_revenue"),
            (F.floor(F.min(price)) - 2000).cast("double").alias("amt_net_profit"),
            whole(qty).alias("amt_operating_revenues_and_expenses"),
            whole(price).alias("amt_sales_revenue"),
        )
    )
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return panel.join(names, panel.l_suppkey == names.s_suppkey, "left").select(
        _company("l_suppkey").alias("id_cnpj"),
        F.concat(F.lit("CVM"), F.col("l_suppkey").cast("string")).alias("id_cvm"),
        F.col("s_name").alias("txt_company_name"),
        F.date_sub(F.add_months("q", 3), 1).alias("dt_refer"),
        F.col("q").alias("dt_ini_exerc"),
        F.col("dt_last").alias("processed_at"),
        F.date_sub(F.add_months("q", 3), 1).alias("dt_fim_exerc"),
        F.year("q").alias("dt_year"),
        F.quarter("q").alias("dt_quarter"),
        *[c for c in panel.columns if c.startswith("amt_")],
    )


def messy_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price panel as it arrives: several rows per key, and rows of an unknown company."""
    raw = raw_prices(spark, sf_dir)
    unknown = F.col("id_cnpj").substr(13, 2) == "50"
    known = raw.withColumn("id_cnpj", F.when(unknown, F.lit("0" * 14)).otherwise(F.col("id_cnpj")))
    return known.withColumn("id_isin", F.concat(F.lit("BR"), "id_cnpj", "ticker"))


def messy_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statements as they arrive: up to two versions each, some without a reference date."""
    price = F.col("l_extendedprice")
    disc, tax = F.col("l_discount"), F.col("l_tax")

    def whole(c):
        return F.floor(F.max(c)).cast("double")

    panel = (
        table(spark, sf_dir, "lineitem")
        .withColumn("m", F.trunc(F.to_date("l_shipdate"), "month"))
        .groupBy("l_suppkey", "m", (F.col("l_linenumber") % 2).alias("version"))
        .agg(
            F.to_date(F.max("l_shipdate")).alias("processed_at"),
            whole(price * disc).alias("amt_cost_goods_and_services"),
            whole(price * (1 - tax)).alias("amt_earnings_before_income_tax_and_social_contribution"),
            whole(price * (1 - disc)).alias("amt_earnings_before_interest_and_taxes"),
            (F.floor(F.min(price * tax)) - 50).cast("double").alias("amt_financial_results"),
            whole(price * (1 + tax)).alias("amt_groos_revenue"),
            (F.floor(F.min(price)) - 2000).cast("double").alias("amt_net_profit"),
            whole("l_quantity").alias("amt_operating_revenues_and_expenses"),
            whole(price).alias("amt_sales_revenue"),
        )
    )
    last = F.last_day("m")
    missing = (F.col("l_suppkey") % 7 == 0) & (F.month("m") == 3)
    return panel.select(
        _company("l_suppkey").alias("id_cnpj"),
        F.concat(F.lit("CVM"), F.col("l_suppkey").cast("string")).alias("id_cvm"),
        F.concat(F.lit("Company "), F.col("l_suppkey").cast("string")).alias("txt_company_name"),
        F.when(~missing, last).alias("dt_refer"),
        F.col("m").alias("dt_ini_exerc"),
        "processed_at",
        last.alias("dt_fim_exerc"),
        F.year("m").alias("dt_year"),
        F.quarter("m").alias("dt_quarter"),
        *[c for c in panel.columns if c.startswith("amt_")],
    )


def scored(spark: SparkSession, sf_dir: str, score: str = "l_extendedprice") -> DataFrame:
    """Labelled scores: nearly unique (price) or full of ties (discount), with month and split keys."""
    cut = {"l_extendedprice": 52500.0, "l_discount": 0.05}[score]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("dt_year"),
        F.month("l_shipdate").alias("dt_month"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("cat_target"),
        F.col(score).alias("prob"),
        F.when(F.col(score) > cut, 1).otherwise(0).alias("prediction"),
    )


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and unbalanced: document quality scored by length, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("lang").alias("period"),
        F.col("quality").alias("cat_target"),
        F.col("n_chars").cast("double").alias("prob"),
    )
