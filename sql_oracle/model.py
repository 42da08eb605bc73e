"""The model tables over the star tables, as common table expressions."""

MODEL = """
priced AS (
    SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders
),
purchased AS (
    SELECT o_orderkey AS k, o_custkey AS c, p, o_orderdate,
           CASE WHEN o_orderstatus = 'P' THEN 'shipped' ELSE 'delivered' END AS order_status,
           o_orderdate + to_seconds(p % 86400) AS purchase,
           CASE WHEN k % 101 <> 0 THEN (p * 13 + k * 31) % 1036800 - 3600 END AS c_s,
           CASE WHEN k % 100 = 0 THEN 5184000 WHEN k % 50 = 0 THEN 2592000
                WHEN k % 20 = 0 THEN 1296000 ELSE 0 END AS tail_s
    FROM priced
),
m_orders AS (
    SELECT k AS order_id, c AS customer_id, order_status,
           purchase AS order_purchase_timestamp,
           CASE WHEN k % 97 <> 0 THEN purchase + to_seconds((p * 7 + k) % 172800) END AS order_approved_at,
           purchase + to_seconds(c_s) AS order_delivered_carrier_date,
           CASE WHEN order_status = 'delivered' AND k % 89 <> 0
                THEN purchase + to_seconds(coalesce(c_s, 259200) + (p * 17 + c * 101) % 1382400 - 7200 + tail_s)
           END AS order_delivered_customer_date,
           CAST(o_orderdate + to_days(CAST(10 + p % 35 AS INTEGER)) AS TIMESTAMP) AS order_estimated_delivery_date
    FROM purchased
),
m_customers AS (
    SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id,
           n_name AS customer_state, c_mktsegment AS customer_city
    FROM customer JOIN nation ON c_nationkey = n_nationkey
),
m_sellers AS (
    SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
m_products AS (
    SELECT p_partkey AS product_id, p_type AS product_category_name, p_size * 100 AS product_weight_g,
           CASE WHEN p_partkey % 53 <> 0 THEN 10 + p_partkey % 61 END AS product_length_cm,
           2 + p_partkey * 7 % 47 AS product_height_cm, 5 + p_partkey * 13 % 41 AS product_width_cm
    FROM part
),
m_translation AS (
    SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
    FROM part WHERE p_type <> 'ECONOMY'
),
m_items AS (
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
           l_shipdate AS shipping_limit_date,
           CAST(round(l_extendedprice * 100) AS BIGINT) % 5000 AS freight_cents
    FROM lineitem
),
m_payments AS (
    SELECT o_orderkey AS order_id, s AS payment_sequential,
           CASE (o_orderkey + s) % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto'
                WHEN 2 THEN 'voucher' ELSE 'debit_card' END AS payment_type,
           1 + o_orderkey % 12 AS payment_installments,
           p // CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS payment_cents
    FROM priced, (VALUES (1), (2)) AS n(s)
    WHERE s = 1 OR o_orderkey % 3 = 0
),
m_reviews AS (
    SELECT l_partkey AS review_id, l_orderkey AS order_id,
           CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS INTEGER) AS review_score, l_shipdate AS review_creation_date
    FROM lineitem
),
delivered AS (
    SELECT o.order_id, c.customer_state, c.customer_city, o.order_purchase_timestamp, o.order_approved_at,
           o.order_delivered_carrier_date, o.order_delivered_customer_date, o.order_estimated_delivery_date,
           CAST(date_trunc('month', o.order_purchase_timestamp) AS DATE) AS purchase_month,
           CAST(o.order_delivered_customer_date AS DATE) > CAST(o.order_estimated_delivery_date AS DATE) AS is_late,
           CAST(date_diff('day', CAST(o.order_estimated_delivery_date AS DATE),
                          CAST(o.order_delivered_customer_date AS DATE)) AS INTEGER) AS days_vs_estimate,
           CAST(date_diff('day', CAST(o.order_purchase_timestamp AS DATE),
                          CAST(o.order_delivered_customer_date AS DATE)) AS INTEGER) AS delivery_days,
           CAST(date_diff('day', CAST(o.order_purchase_timestamp AS DATE),
                          CAST(o.order_estimated_delivery_date AS DATE)) AS INTEGER) AS promise_days,
           date_diff('microsecond', o.order_purchase_timestamp, o.order_delivered_customer_date) / 86400e6
               AS cycle_days,
           date_diff('microsecond', o.order_purchase_timestamp, o.order_approved_at) / 3600e6 AS approve_hours,
           CASE WHEN o.order_delivered_carrier_date >= o.order_approved_at
                THEN date_diff('microsecond', o.order_approved_at, o.order_delivered_carrier_date) / 86400e6
           END AS handover_days,
           CASE WHEN o.order_delivered_customer_date >= o.order_delivered_carrier_date
                THEN date_diff('microsecond', o.order_delivered_carrier_date, o.order_delivered_customer_date)
                     / 86400e6
           END AS transit_days
    FROM m_orders AS o
    JOIN m_customers AS c USING (customer_id)
    WHERE o.order_status = 'delivered'
      AND o.order_delivered_customer_date IS NOT NULL
      AND o.order_purchase_timestamp >= TIMESTAMP '1995-03-01'
      AND o.order_purchase_timestamp < TIMESTAMP '2001-08-01'
),
last_reviews AS (
    SELECT order_id, review_score
    FROM m_reviews
    QUALIFY row_number() OVER (
        PARTITION BY order_id ORDER BY review_creation_date DESC NULLS FIRST, review_id DESC NULLS FIRST) = 1
)"""


def pct(part: str, whole: str, digits: int = 2) -> str:
    """Share in percent, rounded half up in integers; NULL when the whole is zero."""
    return ratio(f"100 * ({part})", whole, digits)


def ratio(n: str, d: str, digits: int = 2) -> str:
    """Quotient of two integers, n >= 0, rounded half up."""
    return f"((2 * {10**digits} * ({n}) + ({d})) // (2 * nullif(({d}), 0))) / {float(10**digits)}"


def mean(column: str, digits: int = 2) -> str:
    return ratio(f"sum({column})", f"count({column})", digits)


def cont(column: str, point: float, digits: int | None = 2) -> str:
    """Interpolated percentile, rounded through a decimal."""
    value = f"CAST(quantile_cont({column}, {point}) AS DOUBLE)"
    return value if digits is None else rounded(value, digits)


def rounded(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def bucket(column: str, edges=(3, 7, 14, 23, 30, 60), first: int = 0, closed: bool = False) -> str:
    lows = [first, *(edge + 1 for edge in edges)]
    tests = [f"{column} BETWEEN {low} AND {high}" for low, high in zip(lows, edges)]
    if not closed:
        tests[0] = f"{column} <= {edges[0]}"
    arms = " ".join(f"WHEN {test} THEN {number}" for number, test in enumerate(tests, start=1))
    return f"CASE {arms} ELSE {len(edges) + 1} END"


def label(number: str, edges=(3, 7, 14, 23, 30, 60), first: int = 0, suffix: str = "") -> str:
    lows = [first, *(edge + 1 for edge in edges)]
    names = [f"{low}-{high}" for low, high in zip(lows, edges)] + [f"{lows[-1]}+"]
    arms = " ".join(f"WHEN {i} THEN '{name}{suffix}'" for i, name in enumerate(names, start=1))
    return f"CASE {number} {arms} END"
