"""Scores."""

from sql_oracle.model import bucket, cont, label, mean, pct


def _scores(digits):
    return f"""count(*) AS orders_count, {mean('review_score')} AS avg_review_score,
       {cont('review_score', 0.5, digits)} AS median_review_score,
       count(*) FILTER (review_score = 1) AS orders_with_score_1,
       {pct('count(*) FILTER (review_score = 1)', 'count(*)')} AS pct_orders_with_score_1,
       count(*) FILTER (review_score = 2) AS orders_with_score_2,
       {pct('count(*) FILTER (review_score = 2)', 'count(*)')} AS pct_orders_with_score_2"""


_BAD = f"""count(*) AS orders_count, count(*) FILTER (review_score <= 2) AS bad_reviews,
       {pct('count(*) FILTER (review_score <= 2)', 'count(*)')} AS bad_reviews_pct"""

_ON_TIME = f"""on_time AS (
    SELECT {bucket('delivery_days')} AS bucket_no, review_score
    FROM delivered JOIN last_reviews USING (order_id) WHERE NOT is_late)"""

REVIEWS = {
    "q04a_score_distribution": f"""
        WITH sized AS (
            SELECT review_score, count(*) AS orders_count
            FROM delivered LEFT JOIN last_reviews USING (order_id) GROUP BY ALL)
        SELECT review_score, orders_count, {pct('orders_count', '(SELECT count(*) FROM delivered)')} AS pct
        FROM sized ORDER BY review_score NULLS LAST""",
    "q04b_score_by_lateness": f"""
        SELECT is_late, {_scores(None)} FROM delivered JOIN last_reviews USING (order_id) GROUP BY is_late""",
    "q04c_score_by_bucket_on_time": f"""
        WITH {_ON_TIME} SELECT {label('bucket_no')} AS bucket, {_scores(2)} FROM on_time GROUP BY bucket_no
        ORDER BY bucket_no""",
    "d11_bad_by_lateness": f"""
        SELECT is_late, {_BAD} FROM delivered JOIN last_reviews USING (order_id) GROUP BY is_late""",
    "d11_bad_by_bucket": f"""
        WITH {_ON_TIME} SELECT {label('bucket_no')} AS bucket, {_BAD} FROM on_time GROUP BY bucket_no
        ORDER BY bucket_no""",
}
