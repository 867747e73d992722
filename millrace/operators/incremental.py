"""KPI tables kept up to date: which of their keys a change touches, and the tables cut down to these keys.

A change feed has both images of a changed row. Keys that it names itself, and keys that it leads to through tables as they are now,
are all that can differ: where a row on the way has changed too, its own images name the keys that it led to before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Kept:
    """``key``: the columns that tell rows apart; ``uses``: columns by table that the KPI looks at; ``touched(now, changed)``:
    keys that may differ; ``only(now, keys)``: tables cut down so that the KPI over them has the rows of these keys."""

    key: tuple[str, ...]
    uses: dict[str, tuple[str, ...]]
    touched: Callable[[Tables, Tables], DataFrame]
    only: Callable[[Tables, DataFrame], Tables]


def within(df: DataFrame, keys: DataFrame, *by: Column) -> DataFrame:
    """Rows whose ``by`` is one of ``keys``, column by column; NULL equals NULL."""
    renamed = keys.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(keys.columns)))
    return df.join(renamed, reduce(Column.__and__, (b.eqNullSafe(F.col(f"_key{k}")) for k, b in enumerate(by))), "left_semi")


def _lines(now: Tables, changed: Tables, column: str) -> DataFrame:
    """(column): what the lines that changed have there, and the lines whose product or returns did."""
    parts = [changed["order_items"].select(column)]
    for name, link in (("products", "product_id"), ("returns", "order_item_id")):
        if name in changed and link != column:
            parts.append(now["order_items"].join(changed[name].select(link).distinct(), link, "left_semi").select(column))
    return reduce(DataFrame.unionByName, parts).distinct()


def _of_orders(now: Tables, changed: Tables, column: str) -> DataFrame:
    """(column): what orders that changed have there, before and after, and the orders of lines that did."""
    theirs = now["orders"].join(_lines(now, changed, "order_id"), "order_id", "left_semi")
    return changed["orders"].select(column).unionByName(theirs.select(column)).distinct()


def _months(now: Tables, changed: Tables) -> DataFrame:
    return _of_orders(now, changed, "order_date").select(F.year("order_date").alias("year"), F.month("order_date").alias("month")).distinct()


def _kinds(now: Tables, changed: Tables) -> DataFrame:
    kind = ["category", "subcategory"]
    sold = now["products"].join(_lines(now, changed, "product_id"), "product_id", "left_semi")
    return changed["products"].select(*kind).unionByName(sold.select(*kind)).distinct()


def _members(name: str, key: str) -> Callable[[Tables, Tables], DataFrame]:
    return lambda now, changed: changed[name].select(key).unionByName(_of_orders(now, changed, key)).distinct()


def _cut(*names: str) -> Callable[[Tables, DataFrame], Tables]:
    """``names`` cut down to keys by columns of the same names."""
    return lambda now, keys: now | {n: within(now[n], keys, *map(F.col, keys.columns)) for n in names}


_ORDER = ("order_id", "order_date")
_RETURN = ("return_id", "order_item_id", "refund_amount")

#: By the names of ``kpi.KPI``.
KEPT = {
    "gold_daily_sales_performance": Kept(
        ("order_date",),
        {"orders": _ORDER, "order_items": ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_amount", "net_amount"), "products": ("product_id", "cost_price"), "returns": _RETURN},
        lambda now, changed: _of_orders(now, changed, "order_date"),
        _cut("orders"),
    ),
    "gold_monthly_revenue": Kept(
        ("year", "month"),
        {"orders": _ORDER, "order_items": ("order_item_id", "order_id", "quantity", "net_amount"), "returns": _RETURN},
        _months,
        lambda now, keys: now | {"orders": within(now["orders"], keys, F.year("order_date"), F.month("order_date"))},
    ),
    "gold_revenue_by_store_region": Kept(
        ("store_id",),
        {"orders": ("order_id", "store_id"), "order_items": ("order_id", "net_amount"), "stores": ("store_id", "store_name", "store_type", "region", "state", "country")},
        _members("stores", "store_id"),
        _cut("stores", "orders"),
    ),
    "gold_category_revenue_performance": Kept(
        ("category", "subcategory"),
        {"order_items": ("order_item_id", "product_id", "quantity", "unit_price", "discount_amount", "net_amount"), "products": ("product_id", "category", "subcategory"), "returns": _RETURN},
        _kinds,
        _cut("products"),
    ),
    "gold_customer_spending_summary": Kept(
        ("customer_id",),
        {"customers": ("customer_id", "first_name", "last_name", "email", "loyalty_tier"), "orders": ("order_id", "customer_id", "order_date"), "order_items": ("order_id", "net_amount")},
        _members("customers", "customer_id"),
        _cut("customers", "orders"),
    ),
    "gold_return_refund_performance": Kept(
        ("return_reason",),
        {"returns": ("return_id", "return_reason", "refund_amount")},
        lambda now, changed: changed["returns"].select("return_reason").distinct(),
        _cut("returns"),
    ),
}
