"""Raw retail datasets: every column is nullable text, so that defects survive ingestion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Dataset:
    name: str
    columns: tuple[str, ...]
    file_format: str = "csv"

    @property
    def key(self) -> str:
        return self.columns[0]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c, StringType(), True) for c in self.columns])


# Column names and their order in the delivered files.
DATASETS = {
    d.name: d
    for d in (
        Dataset("customers", ("customer_id", "first_name", "last_name", "email", "phone", "address", "city", "state", "country", "postal_code", "signup_date", "loyalty_tier")),
        Dataset("products", ("product_id", "product_sku", "product_name", "category", "subcategory", "unit_price", "cost_price", "is_active", "description")),
        Dataset("stores", ("store_id", "store_name", "store_type", "region", "state", "country", "opened_date")),
        Dataset("employees", ("employee_id", "store_id", "first_name", "last_name", "email", "role", "hire_date", "is_active")),
        Dataset("orders", ("order_id", "customer_id", "store_id", "employee_id", "order_timestamp", "order_status", "channel", "shipping_cost", "tax_amount", "order_subtotal", "total_amount")),
        Dataset("order_items", ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_percent")),
        Dataset("payments", ("payment_id", "order_id", "payment_timestamp", "payment_method", "payment_status", "payment_amount", "transaction_reference"), "json"),
        Dataset("returns", ("return_id", "order_item_id", "return_timestamp", "return_reason", "refund_amount", "return_status")),
    )
}
LINEAGE = ("_ingestion_id", "_source_file", "_source_path", "_ingestion_date", "_adf_run_id", "_ingested_timestamp")
