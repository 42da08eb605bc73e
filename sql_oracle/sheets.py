"""Dashboard sheets."""

from sql_oracle.model import bucket, cont, label, mean, pct
from sql_oracle.sla import _CUSHION, _SIZES

_REVIEWED = f"""count(review_score) AS reviews_count, {mean('review_score')} AS avg_review_score,
       {cont('review_score', 0.5)} AS median_review_score"""

_JOINED = "delivered LEFT JOIN last_reviews USING (order_id)"
_COUNTS = "count(*) AS n, count(*) FILTER (is_late) AS l"

SHEETS = {
    "q05a_flat_orders": f"""
        SELECT order_id, purchase_month, customer_state, delivery_days, days_vs_estimate, is_late, promise_days,
               review_score, {label('bucket_no', suffix=' дн.')} AS bucket, CAST(bucket_no AS INTEGER) AS bucket_no
        FROM (SELECT *, {bucket('delivery_days')} AS bucket_no FROM {_JOINED})""",
    "q05b_month_sheet": f"""
        SELECT purchase_month, {_SIZES}, {cont('promise_days', 0.5)} AS median_promise_days,
               {_CUSHION} AS cushion_days, {_REVIEWED}
        FROM {_JOINED} GROUP BY purchase_month ORDER BY purchase_month""",
    "q05c_state_sheet": f"""
        SELECT customer_state, {_SIZES}, {cont('promise_days', 0.5)} AS median_promise_days, {_REVIEWED}
        FROM {_JOINED} GROUP BY customer_state ORDER BY orders_count DESC, customer_state""",
    "q05d_reconciliation": f"""
        WITH by_month AS (SELECT purchase_month, {_COUNTS} FROM {_JOINED} GROUP BY purchase_month),
             by_state AS (SELECT customer_state, {_COUNTS} FROM {_JOINED} GROUP BY customer_state),
             totals AS (
                 SELECT 'flat table of orders' AS check_name, {_COUNTS} FROM {_JOINED}
                 UNION ALL SELECT 'total by month', CAST(sum(n) AS BIGINT), CAST(sum(l) AS BIGINT) FROM by_month
                 UNION ALL SELECT 'total by state', CAST(sum(n) AS BIGINT), CAST(sum(l) AS BIGINT) FROM by_state
                 UNION ALL SELECT 'delivered_orders', {_COUNTS} FROM delivered)
        SELECT check_name, n AS orders_count, l AS late_orders_count, {pct('l', 'n')} AS late_orders_pct,
               (SELECT count(DISTINCT n) = 1 AND count(DISTINCT l) = 1 FROM totals) AS agree
        FROM totals""",
}
