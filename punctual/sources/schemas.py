"""Declared column types, keys and references of the eight tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TEXT, _INT, _TIME, _MONEY = StringType(), IntegerType(), TimestampNTZType(), DecimalType(10, 2)


def _table(required: tuple[str, ...] = (), **columns: DataType) -> StructType:
    return StructType([StructField(name, kind, name not in required) for name, kind in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "customers": _table(
        required=("customer_id", "customer_unique_id"),
        customer_id=_TEXT,
        customer_unique_id=_TEXT,
        customer_zip_code_prefix=_TEXT,
        customer_city=_TEXT,
        customer_state=_TEXT,
    ),
    "sellers": _table(
        required=("seller_id",),
        seller_id=_TEXT,
        seller_zip_code_prefix=_TEXT,
        seller_city=_TEXT,
        seller_state=_TEXT,
    ),
    "products": _table(
        required=("product_id",),
        product_id=_TEXT,
        product_category_name=_TEXT,
        product_name_length=_INT,
        product_description_length=_INT,
        product_photos_qty=_INT,
        product_weight_g=_INT,
        product_length_cm=_INT,
        product_height_cm=_INT,
        product_width_cm=_INT,
    ),
    "category_translation": _table(
        required=("product_category_name",),
        product_category_name=_TEXT,
        product_category_name_english=_TEXT,
    ),
    "orders": _table(
        required=("order_id",),
        order_id=_TEXT,
        customer_id=_TEXT,
        order_status=_TEXT,
        order_purchase_timestamp=_TIME,
        order_approved_at=_TIME,
        order_delivered_carrier_date=_TIME,
        order_delivered_customer_date=_TIME,
        order_estimated_delivery_date=_TIME,
    ),
    "order_items": _table(
        required=("order_id", "order_item_id"),
        order_id=_TEXT,
        order_item_id=_INT,
        product_id=_TEXT,
        seller_id=_TEXT,
        shipping_limit_date=_TIME,
        price=_MONEY,
        freight_value=_MONEY,
    ),
    "order_payments": _table(
        required=("order_id", "payment_sequential"),
        order_id=_TEXT,
        payment_sequential=_INT,
        payment_type=_TEXT,
        payment_installments=_INT,
        payment_value=_MONEY,
    ),
    "order_reviews": _table(
        review_id=_TEXT,
        order_id=_TEXT,
        review_score=_INT,
        review_comment_title=_TEXT,
        review_comment_message=_TEXT,
        review_creation_date=_TIME,
        review_answer_timestamp=_TIME,
    ),
}

# Spark does not enforce keys; operators.constraints checks them instead.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "category_translation": ("product_category_name",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
}

# (table, column) -> (table, column)
FOREIGN_KEYS: dict[tuple[str, str], tuple[str, str]] = {
    ("orders", "customer_id"): ("customers", "customer_id"),
    ("order_items", "order_id"): ("orders", "order_id"),
    ("order_items", "product_id"): ("products", "product_id"),
    ("order_items", "seller_id"): ("sellers", "seller_id"),
    ("order_payments", "order_id"): ("orders", "order_id"),
    ("order_reviews", "order_id"): ("orders", "order_id"),
}

REQUIRED: dict[str, tuple[str, ...]] = {"customers": ("customer_unique_id",)}
