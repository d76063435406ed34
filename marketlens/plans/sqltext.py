"""DuckDB SQL text: the table derivation as CTEs and the numeric recipe.

Oracle strings see only the driver's raw views, so each one starts with the
derivation below (``m_<table>``; ``orders`` is already a raw view name).
This text is independent of the DataFrame code it checks.
"""

from __future__ import annotations

import datetime as dt


def ADD(ts: str, d: str, h: str = "0") -> str:
    return f"({ts} + to_days(cast({d} as int)) + to_hours(cast({h} as int)))"


def CENTS(e: str) -> str:
    return f"cast(({e}) * cast(0.01 as decimal(3,2)) as decimal(10,2))"


def r(x: str, n: int = 2) -> str:
    return f"cast(round(cast({x} as decimal(38,10)), {n}) as double)"


def avg2(c: str, n: int = 2) -> str:
    return r(f"(cast(sum({c}) as double) / count({c}))", n)


def pct(a: str, b: str, n: int = 2) -> str:
    return r(f"(cast({a} as double) * 100.0 / nullif(cast({b} as double), 0))", n)


def sum_if(cond: str, value: str = "1") -> str:
    return f"sum(case when {cond} then {value} else 0 end)"


def date_lit(d: dt.date | str) -> str:
    return f"DATE '{d}'"


DERIVATION = f"""
m_customers AS (
  SELECT 'c'||cast(o_orderkey as string) AS customer_id,
         'u'||cast(o_custkey as string)||'-'||cast(o_orderkey%7 as string) AS customer_unique_id,
         'Z'||cast(c_nationkey as string) AS customer_zip_code_prefix,
         'city_'||cast(c_nationkey as string) AS customer_city,
         'S'||cast(c_nationkey as string) AS customer_state
  FROM orders JOIN customer ON o_custkey = c_custkey
),
m_orders AS (
  SELECT 'o'||cast(o_orderkey as string) AS order_id,
         'c'||cast(o_orderkey as string) AS customer_id,
         CASE o_orderkey%20 WHEN 0 THEN 'canceled' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'invoiced'
              WHEN 3 THEN 'processing' WHEN 4 THEN 'shipped' ELSE 'delivered' END AS order_status,
         o_orderdate AS order_purchase_timestamp,
         CASE WHEN o_orderkey%50=0 THEN NULL ELSE {ADD('o_orderdate', '0', '1+o_orderkey%23')} END AS order_approved_at,
         CASE WHEN o_orderkey%20<4 THEN NULL ELSE {ADD('o_orderdate', '1+o_orderkey%5')} END AS order_delivered_carrier_date,
         CASE WHEN o_orderkey%20<5 OR o_orderkey%97=0 THEN NULL
              ELSE {ADD('o_orderdate', '10+o_orderkey%31+(CASE WHEN o_orderkey%11=0 THEN (o_orderkey*7919+7)%60 ELSE -((o_orderkey*7919)%20) END)', 'o_orderkey%24')} END
           AS order_delivered_customer_date,
         {ADD('o_orderdate', '10+o_orderkey%31')} AS order_estimated_delivery_date
  FROM orders
),
m_order_items AS (
  SELECT 'o'||cast(l_orderkey as string) AS order_id,
         l_linenumber AS order_item_id,
         'p'||cast(l_partkey as string) AS product_id,
         CASE WHEN l_partkey%20<12 THEN 'A'||cast(l_suppkey-l_suppkey%3 as string)
              WHEN l_partkey%20<16 THEN 'B'||cast(l_suppkey-l_suppkey%4 as string)
              ELSE 'C'||cast(l_suppkey as string) END AS seller_id,
         {ADD('l_shipdate', '3')} AS shipping_limit_date,
         {CENTS('CASE WHEN l_orderkey%211=0 THEN 0 WHEN l_partkey%4=0 THEN cast(floor(l_extendedprice) as bigint) ELSE cast(floor(l_extendedprice/40) as bigint) END')} AS price,
         {CENTS('100+(l_orderkey*31+l_linenumber*1709+l_partkey*7)%2000')} AS freight_value
  FROM lineitem
),
m_products AS (
  SELECT 'p'||cast(p_partkey as string) AS product_id,
         CASE WHEN p_partkey%101=0 THEN NULL ELSE p_name END AS product_category_name,
         cast(length(p_name) as int) AS product_name_length,
         cast(p_partkey%3000 as int) AS product_description_length,
         cast(1+p_partkey%6 as int) AS product_photos_qty,
         cast(p_size*100 as int) AS product_weight_g,
         cast(p_size as int) AS product_length_cm,
         cast(1+p_partkey%40 as int) AS product_height_cm,
         cast(1+p_partkey%50 as int) AS product_width_cm
  FROM part
),
m_sellers AS (
  SELECT sid AS seller_id, 'Z'||cast(nk as string) AS seller_zip_code_prefix,
         'city_'||cast(nk as string) AS seller_city, 'S'||cast(nk as string) AS seller_state
  FROM (SELECT 'A'||cast(s_suppkey as string) AS sid, s_nationkey AS nk FROM supplier WHERE s_suppkey%3=0
        UNION ALL SELECT 'B'||cast(s_suppkey as string), s_nationkey FROM supplier WHERE s_suppkey%4=0
        UNION ALL SELECT 'C'||cast(s_suppkey as string), s_nationkey FROM supplier) x
),
m_payments AS (
  SELECT 'o'||cast(o_orderkey as string) AS order_id,
         n AS payment_sequential,
         CASE WHEN n=2 THEN 'voucher' WHEN o_orderkey%20<15 THEN 'credit_card' WHEN o_orderkey%20<17 THEN 'bank_slip'
              WHEN o_orderkey%20<19 THEN 'voucher' ELSE 'debit_card' END AS payment_type,
         cast(CASE WHEN n=2 OR o_orderkey%20>=15 THEN 1 WHEN o_orderkey%50=0 THEN 0 ELSE 1+o_orderkey%12 END as int) AS payment_installments,
         {CENTS('cast(floor(o_totalprice/10) as bigint)')} AS payment_value
  FROM orders CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) nn
  WHERE n = 1 OR o_orderkey%17 = 0
),
m_reviews AS (
  SELECT 'r'||cast(o_orderkey as string)||'-'||cast(n as string) AS review_id,
         'o'||cast(o_orderkey as string) AS order_id,
         cast(CASE WHEN (o_orderkey*31+n*7)%100 < (CASE WHEN s%12<3 THEN 60 ELSE 12 END) THEN 1+o_orderkey%3
                   WHEN (o_orderkey*17)%10<7 THEN 5 ELSE 4 END as int) AS review_score,
         CASE WHEN o_orderkey%3=0 THEN 'title '||cast(o_orderkey%10 as string) ELSE NULL END AS review_comment_title,
         CASE WHEN o_orderkey%4=0 THEN NULL ELSE 'message '||cast(o_orderkey as string) END AS review_comment_message,
         {ADD('o_orderdate', '45+n')} AS review_creation_date,
         {ADD('o_orderdate', '47+n', 'o_orderkey%24')} AS review_answer_timestamp
  FROM orders
  LEFT JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) f ON k = o_orderkey
  CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) nn
  WHERE o_orderkey%13 <> 0 AND (n = 1 OR o_orderkey%29 = 0)
),
m_geolocation AS (
  SELECT 'Z'||cast(n_nationkey as string) AS geolocation_zip_code_prefix,
         cast(n_nationkey*cast(1.25 as decimal(3,2)) - 20 as decimal(18,15)) AS geolocation_lat,
         cast(n*cast(0.01 as decimal(3,2)) - 40 - n_nationkey as decimal(18,15)) AS geolocation_lng,
         'city_'||cast(n_nationkey as string) AS geolocation_city,
         'S'||cast(n_nationkey as string) AS geolocation_state
  FROM nation CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) nn
)"""


def with_tables(body: str, *extra_ctes: str) -> str:
    """``WITH <derivation>[, extra CTEs] <body>``."""
    ctes = DERIVATION + "".join(f",\n{c}" for c in extra_ctes)
    return f"WITH {ctes}\n{body}"


def without_derivation(sql: str) -> str:
    """The same statement for a database that already has ``m_<table>`` views
    (used to run the oracle on hand-made or random tables)."""
    head = f"WITH {DERIVATION}"
    return sql.replace(head + ",\n", "WITH ").replace(head + "\n", "")
