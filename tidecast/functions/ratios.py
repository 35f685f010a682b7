"""Price, promotion, order and inventory feature expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as a double; 0 where the denominator is zero or anything is missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def ratio_or_self(num: Column, den: Column) -> Column:
    """num / den with a zero denominator read as 1; missing stays missing."""
    return num.cast("double") / F.when(den == 0, F.lit(1.0)).otherwise(den.cast("double"))


def clip_zero(c: Column) -> Column:
    """max(c, 0), keeping missing values missing (``greatest`` alone would return 0)."""
    return F.when(c < 0, F.lit(0).cast("double")).otherwise(c.cast("double"))


def log1p_clipped(c: Column) -> Column:
    return F.log1p(clip_zero(c))


def expm1_clipped(c: Column) -> Column:
    return clip_zero(F.expm1(c))


def to_count(log_forecast: Column) -> Column:
    """Back-transform a log forecast to a whole, non-negative number of units."""
    return expm1_clipped(log_forecast).cast("long")


def discount_columns(base: Column, paid: Column) -> dict[str, Column]:
    amount = base.cast("double") - paid.cast("double")
    return {
        "discount_amount": amount,
        "discount_percent": ratio_or_self(amount, base) * 100,
        "discount_yn": F.coalesce(amount > 0, F.lit(False)).cast("int"),
    }


def promotion_columns(first: Column, second: Column, discount_percent: Column) -> dict[str, Column]:
    count = first.cast("int") + second.cast("int")
    return {
        "promo_count": count,
        "both_promo": first.cast("int") * second.cast("int"),
        "promo_discount_interaction": count * discount_percent,
    }


def order_value_columns(
    quantity: Column, total: Column, sales: Column, discount: Column
) -> dict[str, Column]:
    return {
        "order_value_per_unit": safe_ratio(total, quantity),
        "sales_per_item": safe_ratio(sales, quantity),
        "discount_per_item": safe_ratio(discount, quantity),
        "discount_to_total": safe_ratio(discount, total),
        "sales_to_total": safe_ratio(sales, total),
    }


def competitor_columns(price: Column, competitor: Column, discount_pct: Column) -> dict[str, Column]:
    return {
        "price_ratio": ratio_or_self(price, competitor),
        "price_gap": price - competitor,
        "price_after_discount": price * (1 - discount_pct / 100),
        "discount_amount": price * (discount_pct / 100),
    }


def inventory_columns(level: Column, ordered: Column) -> dict[str, Column]:
    return {
        "inventory_to_order_ratio": safe_ratio(ordered, level),
        "inventory_buffer": level - ordered,
    }
