"""Column functions for stock, quantity and price display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stock below this is shown as low.
LOW_STOCK = 10


def stock_status(quantity: Column) -> Column:
    """'out-of-stock', 'low-stock' or 'in-stock'."""
    return _by_stock(quantity, "out-of-stock", "low-stock", "in-stock")


def stock_text(quantity: Column) -> Column:
    """The same in words."""
    return _by_stock(quantity, "Out of Stock", "Low Stock", "In Stock")


def _by_stock(quantity: Column, none: str, low: str, enough: str) -> Column:
    return F.when(quantity.isNull() | (quantity == 0), none).when(quantity < LOW_STOCK, low).otherwise(enough)


def format_price(price: Column) -> Column:
    """Price with currency sign and two decimals."""
    return F.concat(F.lit("₹"), F.round(price.cast("decimal(38,4)"), 2).cast("decimal(38,2)").cast("string"))


def format_quantity(quantity: Column, category: Column) -> Column:
    """'12.00 kg' for wholesale, '12 items' for everything else."""
    kilos = F.concat(F.round(quantity.cast("decimal(38,4)"), 2).cast("decimal(38,2)").cast("string"), F.lit(" kg"))
    items = F.concat(quantity.cast("bigint").cast("string"), F.lit(" items"))
    return F.when(quantity.isNull(), "Not Available").when(category == "wholesale", kilos).otherwise(items)
