"""The market panel: trailing sums, value and ratios by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.functions.numbers import enterprise_value, ratio
from brindle.operators.joins import exact_then_ffill
from brindle.operators.windows import trailing_sum

TTM_ITEMS = ("total_revenue", "operating_income", "gross_profit", "net_income")


def trailing_twelve_months(quarters: DataFrame, date: str = "date", items=TTM_ITEMS) -> DataFrame:
    return quarters.withColumns({f"{n}_ttm": trailing_sum(n, date) for n in items if n in quarters.columns})


def daily_panel(prices: DataFrame, quarters: DataFrame, date: str = "date") -> DataFrame:
    """Prices with the quarter's figures filled forward, market cap, enterprise value and ratios.

    Figures of a quarter that ends on a day without a price are lost, as the fill follows an exact match.
    prices: date, adj_close, shares; quarters: the items, total_debt, cash, equity.
    """
    q = trailing_twelve_months(quarters, date)
    names = [c for c in q.columns if c != date]
    out = exact_then_ffill(prices, q, date, names)
    out = out.withColumn("marketcap_daily", F.col("adj_close") * F.col("shares"))
    out = out.withColumn("ev_daily", enterprise_value(F.col("marketcap_daily"), F.col("total_debt"), F.col("cash")))
    eps = ratio(F.col("net_income_ttm"), F.col("shares"))
    return out.withColumns({
        "p_s_ttm_x": ratio(F.col("marketcap_daily"), F.col("total_revenue_ttm")), "eps_ttm_x": eps, "p_e_ttm_x": ratio(F.col("adj_close"), eps),
        "debt_equity_x": ratio(F.col("total_debt"), F.col("equity")), "ev_ebitda_x": ratio(F.col("ev_daily"), F.col("operating_income_ttm")),
    })
