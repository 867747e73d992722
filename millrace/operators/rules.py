"""The two rule sets, as data: BATCH for the file pipeline and SILVER for the layered one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from millrace.functions.expr import as_date, as_timestamp, blank, flag, malformed, money, narrowed, parsed, trimmed
from millrace.operators.conform import Parent, Spec

# The e-mail pattern and the status words that count as valid.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
ORDER_STATUS = ("COMPLETED", "PENDING", "CANCELLED", "REFUNDED")
PAYMENT_STATUS = ("SUCCESS", "FAILED", "PENDING")
SILVER_ORDER_STATUS = (*ORDER_STATUS, "PROCESSING")
SILVER_PAYMENT_STATUS = (*PAYMENT_STATUS, "REFUNDED")

Make = Callable[[], Column]


def _c(name: str) -> Make:
    return lambda: F.col(name)


def _trim(*names: str) -> dict[str, Make]:
    return {n: (lambda n=n: trimmed(n)) for n in names}


def _case(how: Callable[[Column], Column], *names: str) -> dict[str, Make]:
    return {n: (lambda n=n: how(trimmed(n))) for n in names}


def _raw(name: str) -> Column:
    return F.col(f"_raw.{name}")


def _date(name: str) -> dict[str, Make]:
    return {name: lambda: as_date(name)}


def _time(name: str) -> dict[str, Make]:
    return {name: lambda: as_timestamp(name)}


def _money(precision: int, *names: str) -> dict[str, Make]:
    return {n: (lambda n=n: money(n, precision)) for n in names}


def _desc(name: str) -> Make:
    return lambda: F.col(name).desc_nulls_last()


def _asc(name: str) -> Make:
    return lambda: F.col(name).asc_nulls_last()


def _any_blank(*names: str) -> Make:
    def make() -> Column:
        out = F.lit(False)
        for n in names:
            out = out | blank(F.col(n).cast("string"))
        return out

    return make


def _not_positive(name: str) -> Make:
    return lambda: F.col(name) <= 0


def _bad_email() -> Column:
    return ~F.col("email").rlike(EMAIL)


BATCH = {
    s.name: s
    for s in (
        Spec(
            "customers", "customer_id",
            _trim("customer_id", "phone", "address", "postal_code") | _case(F.initcap, "first_name", "last_name", "city") | _case(F.lower, "email") | _case(F.upper, "state")
            | {"country": lambda: F.upper(F.coalesce(trimmed("country"), F.lit("US"))), "loyalty_tier": lambda: F.upper(F.coalesce(trimmed("loyalty_tier"), F.lit("STANDARD")))}
            | _date("signup_date")
            | {"full_name": lambda: F.concat_ws(" ", F.initcap(trimmed("first_name")), F.initcap(trimmed("last_name")))},
            (_desc("signup_date"), _asc("email")),
            (
                ("NULL_MANDATORY_FIELD", _any_blank("customer_id", "email")),
                ("DUPLICATE_CUSTOMER_ID", "duplicate"),
                ("INVALID_EMAIL_FORMAT", _bad_email),
                ("MALFORMED_SIGNUP_DATE", lambda: malformed(_raw("signup_date"), "signup_date")),
            ),
            ("customer_id", "first_name", "last_name", "full_name", "email", "phone", "address", "city", "state", "country", "postal_code", "signup_date", "loyalty_tier"),
        ),
        Spec(
            "products", "product_id",
            _trim("product_id", "product_sku", "product_name", "description") | _case(F.initcap, "category", "subcategory") | _money(10, "unit_price", "cost_price") | {"is_active": lambda: flag("is_active", ("true", "t", "1", "yes", "y"))},
            (_asc("product_sku"),),
            (
                ("NULL_MANDATORY_FIELD", _any_blank("product_id", "product_name", "unit_price")),
                ("DUPLICATE_PRODUCT_ID", "duplicate"),
                ("INVALID_PRICE_NON_POSITIVE", _not_positive("unit_price")),
            ),
            ("product_id", "product_sku", "product_name", "category", "subcategory", "unit_price", "cost_price", "is_active", "description"),
        ),
        Spec(
            "stores", "store_id",
            _trim("store_id", "store_name") | _case(F.initcap, "store_type", "region") | _case(F.upper, "state", "country") | _date("opened_date"),
            (_desc("opened_date"),),
            (("NULL_MANDATORY_FIELD", _any_blank("store_id")), ("DUPLICATE_STORE_ID", "duplicate")),
            ("store_id", "store_name", "store_type", "region", "state", "country", "opened_date"),
        ),
        Spec(
            "employees", "employee_id",
            _trim("employee_id", "store_id", "role") | _case(F.initcap, "first_name", "last_name") | _case(F.lower, "email") | _date("hire_date") | {"is_active": lambda: flag("is_active", ("true", "t", "1"))},
            (_desc("hire_date"),),
            (("NULL_MANDATORY_FIELD", _any_blank("employee_id")), ("DUPLICATE_EMPLOYEE_ID", "duplicate"), Parent("store_id", "stores", "ORPHAN_STORE_FK")),
            ("employee_id", "store_id", "first_name", "last_name", "email", "role", "hire_date", "is_active"),
        ),
        Spec(
            "orders", "order_id",
            _trim("order_id", "customer_id", "store_id", "employee_id") | _case(F.upper, "order_status", "channel") | _time("order_timestamp") | _money(10, "shipping_cost", "tax_amount") | _money(12, "order_subtotal", "total_amount")
            | {"order_date": lambda: as_timestamp("order_timestamp").cast("date")},
            (_desc("order_timestamp"),),
            (
                ("NULL_MANDATORY_FIELD", _any_blank("order_id", "total_amount")),
                ("DUPLICATE_ORDER_ID", "duplicate"),
                ("MALFORMED_ORDER_TIMESTAMP", lambda: malformed(_raw("order_timestamp"), "order_timestamp")),
                ("INVALID_ORDER_STATUS", lambda: ~F.col("order_status").isin(*ORDER_STATUS)),  # a NULL status passes
                Parent("customer_id", "customers", "ORPHAN_CUSTOMER_FK"),
                Parent("store_id", "stores", "ORPHAN_STORE_FK"),
                Parent("employee_id", "employees", "ORPHAN_EMPLOYEE_FK"),
            ),
            ("order_id", "customer_id", "store_id", "employee_id", "order_timestamp", "order_date", "order_status", "channel", "shipping_cost", "tax_amount", "order_subtotal", "total_amount"),
        ),
        Spec(
            "order_items", "order_item_id",
            _trim("order_item_id", "order_id", "product_id") | {"quantity": lambda: parsed("quantity", "int"), "discount_percent": lambda: F.coalesce(parsed("discount_percent", "decimal(5,2)"), F.lit(0).cast("decimal(5,2)"))} | _money(10, "unit_price"),
            (_asc("order_id"),),
            (
                ("NULL_MANDATORY_FIELD", _any_blank("order_item_id", "quantity", "unit_price")),
                ("DUPLICATE_ORDER_ITEM_ID", "duplicate"),
                ("INVALID_QUANTITY_NON_POSITIVE", _not_positive("quantity")),
                ("INVALID_UNIT_PRICE_NON_POSITIVE", _not_positive("unit_price")),
                Parent("order_id", "orders", "ORPHAN_ORDER_FK"),
                Parent("product_id", "products", "ORPHAN_PRODUCT_FK"),
            ),
            ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_percent"),
        ),
        Spec(
            "payments", "payment_id",
            _trim("payment_id", "order_id", "transaction_reference") | _case(F.upper, "payment_method", "payment_status") | _time("payment_timestamp") | _money(12, "payment_amount"),
            (_desc("payment_timestamp"),),
            (
                ("NULL_MANDATORY_FIELD", _any_blank("payment_id", "payment_amount")),
                ("DUPLICATE_PAYMENT_ID", "duplicate"),
                ("INVALID_PAYMENT_STATUS", lambda: ~F.col("payment_status").isin(*PAYMENT_STATUS)),  # a NULL status passes
                Parent("order_id", "orders", "ORPHAN_ORDER_FK", carry=("total_amount",)),
                ("PAYMENT_AMOUNT_UNRECONCILED", lambda: (F.col("payment_status") == "SUCCESS") & (F.abs(F.col("payment_amount") - F.col("p_total_amount")) > F.lit(0.01).cast("decimal(12,2)"))),
            ),
            ("payment_id", "order_id", "payment_timestamp", "payment_method", "payment_status", "payment_amount", "transaction_reference"),
        ),
        Spec(
            "returns", "return_id",
            _trim("return_id", "order_item_id") | _case(F.upper, "return_reason", "return_status") | _time("return_timestamp") | _money(10, "refund_amount"),
            (_desc("return_timestamp"),),
            (("NULL_MANDATORY_FIELD", _any_blank("return_id", "refund_amount")), ("DUPLICATE_RETURN_ID", "duplicate"), Parent("order_item_id", "order_items", "ORPHAN_ORDER_ITEM_FK")),
            ("return_id", "order_item_id", "return_timestamp", "return_reason", "refund_amount", "return_status"),
        ),
    )
}

_NEWEST = (_desc("_ingested_timestamp"),)


def _missing(*names: str) -> Make:
    def make() -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.col(n).isNull()
        return out

    return make


def _missing_or(name: str, test: Callable[[Column], Column]) -> Make:
    return lambda: F.col(name).isNull() | test(F.col(name))


def _line(place: str) -> Column:
    """Amounts of an order item from its raw text, each rounded to cents as it is derived."""
    gross = parsed("quantity", "int") * money("unit_price")
    discount = narrowed(gross * parsed("discount_percent", "decimal(5,2)"))
    return discount if place == "discount" else narrowed(gross - discount)


SILVER = {
    s.name: s
    for s in (
        Spec(
            "customers", "customer_id",
            _trim("first_name", "last_name", "phone", "address", "city", "state", "postal_code", "country", "loyalty_tier") | _case(F.lower, "email") | _date("signup_date"),
            _NEWEST,
            (
                ("NULL_CUSTOMER_ID", _any_blank("customer_id")),
                ("DUPLICATE_CUSTOMER_ID", "duplicate"),
                ("NULL_MANDATORY_NAME", _missing("first_name", "last_name")),
                ("INVALID_EMAIL_FORMAT", lambda: F.col("email").isNull() | _bad_email()),
                ("MALFORMED_SIGNUP_DATE", _missing("signup_date")),
            ),
        ),
        Spec(
            "products", "product_id",
            _trim("product_sku", "product_name", "category", "subcategory") | _money(10, "cost_price", "unit_price") | {"is_active": lambda: parsed("is_active", "boolean")},
            _NEWEST,
            (
                ("NULL_PRODUCT_ID", _any_blank("product_id")),
                ("DUPLICATE_PRODUCT_ID", "duplicate"),
                ("NULL_MANDATORY_PRODUCT_INFO", _any_blank("product_name")),
                ("INVALID_UNIT_PRICE", _missing_or("unit_price", lambda c: c <= 0)),
                ("INVALID_COST_PRICE", _missing_or("cost_price", lambda c: c <= 0)),
            ),
        ),
        Spec(
            "stores", "store_id",
            _trim("store_name", "store_type", "region", "state", "country") | _date("opened_date"),
            _NEWEST,
            (("NULL_STORE_ID", _any_blank("store_id")), ("DUPLICATE_STORE_ID", "duplicate"), ("NULL_STORE_NAME", _any_blank("store_name")), ("MALFORMED_OPENED_DATE", _missing("opened_date"))),
        ),
        Spec(
            "employees", "employee_id",
            _trim("first_name", "last_name", "role") | _case(F.lower, "email") | _date("hire_date") | {"is_active": lambda: parsed("is_active", "boolean")},
            _NEWEST,
            (
                ("NULL_EMPLOYEE_ID", _any_blank("employee_id")),
                ("DUPLICATE_EMPLOYEE_ID", "duplicate"),
                ("NULL_MANDATORY_NAME", _missing("first_name", "last_name")),
                ("INVALID_EMAIL_FORMAT", lambda: F.col("email").isNull() | _bad_email()),
                ("MALFORMED_HIRE_DATE", _missing("hire_date")),
                Parent("store_id", "stores", "ORPHAN_STORE_FK"),
            ),
        ),
        Spec(
            "orders", "order_id",
            _trim("order_status", "channel") | _time("order_timestamp") | _money(10, "shipping_cost", "tax_amount") | _money(12, "order_subtotal", "total_amount") | {"order_date": lambda: as_timestamp("order_timestamp").cast("date")},
            _NEWEST,
            (
                ("NULL_ORDER_ID", _any_blank("order_id")),
                ("DUPLICATE_ORDER_ID", "duplicate"),
                ("MALFORMED_ORDER_TIMESTAMP", _missing("order_timestamp")),
                ("INVALID_ORDER_STATUS", _missing_or("order_status", lambda c: ~c.isin(*SILVER_ORDER_STATUS))),
                Parent("customer_id", "customers", "ORPHAN_CUSTOMER_FK"),
                Parent("store_id", "stores", "ORPHAN_STORE_FK"),
            ),
        ),
        Spec(
            "order_items", "order_item_id",
            {"quantity": lambda: parsed("quantity", "int"), "discount_percent": lambda: parsed("discount_percent", "decimal(5,2)"), "discount_amount": lambda: _line("discount"), "net_amount": lambda: _line("net")} | _money(10, "unit_price"),
            _NEWEST,
            (
                ("NULL_ORDER_ITEM_ID", _any_blank("order_item_id")),
                ("DUPLICATE_ORDER_ITEM_ID", "duplicate"),
                ("INVALID_QUANTITY", _missing_or("quantity", lambda c: c <= 0)),
                ("INVALID_UNIT_PRICE", _missing_or("unit_price", lambda c: c <= 0)),
                Parent("order_id", "orders", "ORPHAN_ORDER_FK"),
                Parent("product_id", "products", "ORPHAN_PRODUCT_FK"),
            ),
        ),
        Spec(
            "payments", "payment_id",
            _trim("payment_method", "payment_status") | _time("payment_timestamp") | _money(12, "payment_amount"),
            _NEWEST,
            (
                ("NULL_PAYMENT_ID", _any_blank("payment_id")),
                ("DUPLICATE_PAYMENT_ID", "duplicate"),
                ("INVALID_PAYMENT_STATUS", _missing_or("payment_status", lambda c: ~c.isin(*SILVER_PAYMENT_STATUS))),
                ("INVALID_PAYMENT_AMOUNT", _missing_or("payment_amount", lambda c: c <= 0)),
                ("MALFORMED_PAYMENT_TIMESTAMP", _missing("payment_timestamp")),
                Parent("order_id", "orders", "ORPHAN_ORDER_FK"),
            ),
        ),
        Spec(
            "returns", "return_id",
            _trim("return_reason", "return_status") | _time("return_timestamp") | _money(10, "refund_amount"),
            _NEWEST,
            (
                ("NULL_RETURN_ID", _any_blank("return_id")),
                ("DUPLICATE_RETURN_ID", "duplicate"),
                ("INVALID_REFUND_AMOUNT", _missing_or("refund_amount", lambda c: c < 0)),
                ("MALFORMED_RETURN_TIMESTAMP", _missing("return_timestamp")),
                Parent("order_item_id", "order_items", "ORPHAN_ORDER_ITEM_FK"),
            ),
        ),
    )
}

#: Parents come before children.
ORDER = ("customers", "products", "stores", "employees", "orders", "order_items", "payments", "returns")
