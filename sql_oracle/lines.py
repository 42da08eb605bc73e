"""Items, sellers, payments, people."""

from sql_oracle.model import bucket, cont, label, pct
from sql_oracle.sla import _SIZES

_WEIGHTS = (1000, 2500, 5000, 10000, 20000)
_VOLUMES = (20000, 50000, 100000, 150000, 250000)

LINES = {
    "x1_order_freight": """
        SELECT order_id, count(*) AS items, CAST(sum(freight_cents) AS BIGINT) / 100.0 AS freight
        FROM m_items GROUP BY order_id""",
    "x2_seller_handover": f"""
        SELECT seller_id, count(*) AS items,
               count(*) FILTER (order_delivered_carrier_date > shipping_limit_date) AS late_items,
               {pct('late_items', 'items')} AS late_items_pct
        FROM m_items JOIN m_orders USING (order_id)
        WHERE order_delivered_carrier_date IS NOT NULL GROUP BY seller_id""",
    "x3_translated_categories": """
        SELECT product_category_name, product_category_name_english, count(*) AS products
        FROM m_products LEFT JOIN m_translation USING (product_category_name) GROUP BY ALL""",
    "x4_people": f"""
        WITH persons AS (
            SELECT customer_unique_id, count(*) AS n, count(DISTINCT customer_id) AS ids
            FROM m_orders JOIN m_customers USING (customer_id) GROUP BY ALL)
        SELECT CAST(sum(n) AS BIGINT) AS orders, CAST(sum(ids) AS BIGINT) AS customer_ids, count(*) AS people,
               count(*) FILTER (n > 1) AS repeat_buyers, {pct('repeat_buyers', 'people')} AS repeat_buyers_pct
        FROM persons""",
    "x5_delivery_by_weight": f"""
        WITH weighed AS (
            SELECT order_id, sum(product_weight_g) AS g FROM m_items JOIN m_products USING (product_id) GROUP BY ALL),
        placed AS (SELECT *, {bucket('g', _WEIGHTS)} AS bucket_no FROM delivered JOIN weighed USING (order_id))
        SELECT {label('bucket_no', _WEIGHTS)} AS grams, {_SIZES} FROM placed GROUP BY bucket_no ORDER BY bucket_no""",
    "x5_delivery_by_volume": f"""
        WITH sized AS (
            SELECT order_id, sum(product_length_cm * product_height_cm * product_width_cm) AS v
            FROM m_items JOIN m_products USING (product_id) GROUP BY ALL),
        placed AS (SELECT *, {bucket('v', _VOLUMES)} AS bucket_no FROM delivered JOIN sized USING (order_id))
        SELECT {label('bucket_no', _VOLUMES)} AS cubic_cm, {_SIZES} FROM placed GROUP BY bucket_no ORDER BY bucket_no""",
    "x6_lanes": f"""
        WITH origins AS (SELECT DISTINCT order_id, seller_state FROM m_items JOIN m_sellers USING (seller_id))
        SELECT seller_state, customer_state, {_SIZES}, {cont('promise_days', 0.5)} AS median_promise_days
        FROM delivered JOIN origins USING (order_id) GROUP BY seller_state, customer_state""",
    "x7_order_payments": """
        SELECT order_id, count(*) AS payments, CAST(max(payment_installments) AS INTEGER) AS installments,
               CAST(sum(payment_cents) AS BIGINT) / 100.0 AS paid FROM m_payments GROUP BY order_id""",
    "x8_handover_by_payment": f"""
        WITH firsts AS (SELECT order_id, arg_min(payment_type, payment_sequential) AS payment_type
                        FROM m_payments GROUP BY order_id),
        gaps AS (
            SELECT payment_type, order_delivered_carrier_date < order_approved_at AS broken,
                   CASE WHEN broken THEN CAST(date_diff('microsecond', order_delivered_carrier_date,
                        order_approved_at) // 86400000000 AS INTEGER) END AS days
            FROM m_orders LEFT JOIN firsts USING (order_id)
            WHERE order_delivered_carrier_date IS NOT NULL AND order_approved_at IS NOT NULL)
        SELECT payment_type, count(*) AS orders_count, count(*) FILTER (broken) AS handover_bad,
               {pct('handover_bad', 'orders_count', 3)} AS handover_bad_pct,
               {cont('days', 0.5)} AS median_gap_days, max(days) AS max_gap_days
        FROM gaps GROUP BY payment_type""",
    "x10_late_by_handover": f"""
        SELECT handed_late, count(*) AS orders, count(*) FILTER (is_late) AS late_orders,
               {pct('late_orders', 'orders')} AS late_pct
        FROM (SELECT order_id, any_value(is_late) AS is_late,
                     bool_or(order_delivered_carrier_date > shipping_limit_date) AS handed_late
              FROM delivered JOIN m_items USING (order_id)
              WHERE order_delivered_carrier_date IS NOT NULL GROUP BY order_id)
        GROUP BY handed_late""",
}
