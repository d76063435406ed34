"""Declared schemas of the eight marketplace tables.

Column order is the CSV column order: files bind by position, so the
``StructType`` order is the contract.  Times carry no zone, so they are
``TimestampNTZType``; money stays exact as ``DecimalType(10, 2)``.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(10, 2)
COORD = DecimalType(18, 15)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


CUSTOMERS = _s(
    ("customer_id", StringType()),
    ("customer_unique_id", StringType()),
    ("customer_zip_code_prefix", StringType()),
    ("customer_city", StringType()),
    ("customer_state", StringType()),
)

ORDERS = _s(
    ("order_id", StringType()),
    ("customer_id", StringType()),
    ("order_status", StringType()),
    ("order_purchase_timestamp", TimestampNTZType()),
    ("order_approved_at", TimestampNTZType()),
    ("order_delivered_carrier_date", TimestampNTZType()),
    ("order_delivered_customer_date", TimestampNTZType()),
    ("order_estimated_delivery_date", TimestampNTZType()),
)

ORDER_ITEMS = _s(
    ("order_id", StringType()),
    ("order_item_id", IntegerType()),
    ("product_id", StringType()),
    ("seller_id", StringType()),
    ("shipping_limit_date", TimestampNTZType()),
    ("price", MONEY),
    ("freight_value", MONEY),
)

PRODUCTS = _s(
    ("product_id", StringType()),
    ("product_category_name", StringType()),
    ("product_name_length", IntegerType()),
    ("product_description_length", IntegerType()),
    ("product_photos_qty", IntegerType()),
    ("product_weight_g", IntegerType()),
    ("product_length_cm", IntegerType()),
    ("product_height_cm", IntegerType()),
    ("product_width_cm", IntegerType()),
)

SELLERS = _s(
    ("seller_id", StringType()),
    ("seller_zip_code_prefix", StringType()),
    ("seller_city", StringType()),
    ("seller_state", StringType()),
)

PAYMENTS = _s(
    ("order_id", StringType()),
    ("payment_sequential", IntegerType()),
    ("payment_type", StringType()),
    ("payment_installments", IntegerType()),
    ("payment_value", MONEY),
)

REVIEWS = _s(
    ("review_id", StringType()),
    ("order_id", StringType()),
    ("review_score", IntegerType()),
    ("review_comment_title", StringType()),
    ("review_comment_message", StringType()),
    ("review_creation_date", TimestampNTZType()),
    ("review_answer_timestamp", TimestampNTZType()),
)

GEOLOCATION = _s(
    ("geolocation_zip_code_prefix", StringType()),
    ("geolocation_lat", COORD),
    ("geolocation_lng", COORD),
    ("geolocation_city", StringType()),
    ("geolocation_state", StringType()),
)

# Table name -> schema, in the order the tables are loaded and counted.
SCHEMAS: dict[str, StructType] = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "payments": PAYMENTS,
    "reviews": REVIEWS,
    "geolocation": GEOLOCATION,
}

# Declared primary keys (the other four tables have none).
PRIMARY_KEYS: dict[str, str] = {
    "customers": "customer_id",
    "orders": "order_id",
    "products": "product_id",
    "sellers": "seller_id",
}

# Declared VARCHAR widths, audited (not enforced) by the length audit.
VARCHAR_WIDTHS: dict[str, dict[str, int]] = {
    "customers": {
        "customer_id": 50,
        "customer_unique_id": 50,
        "customer_zip_code_prefix": 10,
        "customer_city": 100,
        "customer_state": 5,
    },
    "orders": {"order_id": 50, "customer_id": 50, "order_status": 20},
    "order_items": {"order_id": 50, "product_id": 50, "seller_id": 50},
    "products": {"product_id": 50, "product_category_name": 100},
    "sellers": {
        "seller_id": 50,
        "seller_zip_code_prefix": 10,
        "seller_city": 100,
        "seller_state": 5,
    },
    "payments": {"order_id": 50, "payment_type": 20},
    "reviews": {"review_id": 50, "order_id": 50, "review_comment_title": 100},
    "geolocation": {
        "geolocation_zip_code_prefix": 10,
        "geolocation_city": 100,
        "geolocation_state": 5,
    },
}
