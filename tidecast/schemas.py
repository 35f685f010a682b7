"""The four supported table shapes: columns, keys, target, feature policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Case:
    name: str
    target: str
    time: str
    keys: tuple[str, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)
    lags: tuple[int, ...] = ()
    windows: tuple[int, ...] = ()
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    target_encoded: tuple[str, ...] = ()
    approved: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in self.columns.items()])


# Column names, lags, windows, ranges and feature lists of the supported tables.
DAILY_SERIES = Case(
    name="case1",
    target="Order_Demand",
    time="Date",
    columns={
        "Product_Code": "string",
        "Warehouse": "string",
        "Product_Category": "string",
        "Date": "string",
        "Order_Demand": "string",
    },
    lags=(1, 7, 14),
    windows=(7, 14),
)

WEEKLY_PANEL = Case(
    name="case2",
    target="num_orders",
    time="week",
    keys=("city_code", "category"),
    columns={
        "week": "int",
        "checkout_price": "double",
        "base_price": "double",
        "emailer_for_promotion": "int",
        "homepage_featured": "int",
        "Region": "string",
        "center_type": "string",
        "category": "string",
        "cuisine": "string",
        "num_orders": "double",
    },
    lags=(1, 4, 8),
    windows=(4,),
    categorical=("Region", "center_type", "category", "cuisine"),
)
WEEK_RANGES = {"train": (1, 100), "val": (101, 125), "test": (126, 145)}

CROSS_SECTION = Case(
    name="case3",
    target="Days for shipping (real)",
    time="order date (DateOrders)",
    approved=(
        "Days for shipment (scheduled)",
        "Shipping Mode",
        "Type",
        "Order Item Quantity",
        "Order Item Total",
        "Sales",
        "Order Item Discount Rate",
        "Order Item Discount",
        "Product Price",
        "Latitude",
        "Longitude",
        "Market",
        "Order Region",
        "Order Country",
        "Order State",
        "order date (DateOrders)",
    ),
    optional=("Department Name", "Category Name", "Customer Segment"),
    denied=(
        "Delivery Status",
        "Late_delivery_risk",
        "shipping date (DateOrders)",
        "Order Profit Per Order",
        "Order Item Profit Ratio",
        "Order Id",
        "Order Item Id",
        "Customer Id",
        "Customer Email",
        "Customer Password",
        "Customer Fname",
        "Customer Lname",
        "Customer Street",
        "Customer Zipcode",
        "Product Image",
        "Product Description",
        "Product Name",
        "Product Status",
    ),
    categorical=(
        "Shipping Mode",
        "Type",
        "Market",
        "Order Region",
        "Department Name",
        "Category Name",
        "Customer Segment",
    ),
    target_encoded=("Order Country", "Order State"),
    numeric=(
        "Order Item Quantity",
        "Order Item Total",
        "Sales",
        "Order Item Discount Rate",
        "Order Item Discount",
        "Product Price",
        "Latitude",
        "Longitude",
        "Days for shipment (scheduled)",
    ),
)

ENTITY_PANEL = Case(
    name="case4",
    target="Units Sold",
    time="Date",
    keys=("Store ID", "Product ID"),
    columns={
        "Date": "date",
        "Store ID": "string",
        "Product ID": "string",
        "Category": "string",
        "Region": "string",
        "Inventory Level": "double",
        "Units Sold": "double",
        "Units Ordered": "double",
        "Demand Forecast": "double",
        "Price": "double",
        "Discount": "double",
        "Weather Condition": "string",
        "Holiday/Promotion": "int",
        "Competitor Pricing": "double",
        "Seasonality": "string",
    },
    lags=(1, 7),
    windows=(7,),
    categorical=("Category", "Region", "Weather Condition", "Seasonality"),
    denied=("Demand Forecast",),
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Check names before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def allowed_columns(df: DataFrame, case: Case) -> list[str]:
    """Target, approved, then optional columns that the table has, in that order."""
    wanted = [case.target, *case.approved, *[c for c in case.optional if c not in case.approved]]
    return [c for c in wanted if c in df.columns]


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    """Every column that is not a target, a time or an identifier."""
    return [c for c in df.columns if c not in exclude]
