"""Working sample and SLA metrics."""

from sql_oracle.model import bucket, cont, label, mean, pct, ratio, rounded

_SIZES = f"""count(*) AS orders_count, count(*) FILTER (is_late) AS late_orders_count,
       {pct('count(*) FILTER (is_late)', 'count(*)')} AS late_orders_pct,
       {cont('delivery_days', 0.5)} AS median_delivery_days, {cont('delivery_days', 0.9)} AS p90_delivery_days"""

_CUSHION = f"{cont('promise_days', 0.5, 0)} - {cont('delivery_days', 0.9, 0)}"

_BUFFER = f"""count(*) AS on_time_orders, {cont('-days_vs_estimate', 0.5, 0)} AS median_buffer,
       {cont('-days_vs_estimate', 0.9, 0)} AS p90_buffer, {cont('-days_vs_estimate', 0.1, 0)} AS p10_buffer,
       max(-days_vs_estimate) AS max_buffer"""

_CURVE = f"""curve AS (
    SELECT 1 - days_vs_estimate AS cut_days, count(*) AS orders_count,
           CAST(sum(count(*)) OVER (ORDER BY 1 - days_vs_estimate) AS BIGINT) AS will_be_late
    FROM delivered WHERE NOT is_late GROUP BY 1 - days_vs_estimate),
base AS (SELECT count(*) AS everything, count(*) FILTER (is_late) AS late FROM delivered),
shares AS (
    SELECT cut_days, orders_count, will_be_late, {pct('will_be_late + late', 'everything')} AS will_be_late_pct,
           {pct('late', 'everything')} AS late_pct FROM curve, base)"""

_DAY_BUCKETS = f"""sized AS (
    SELECT {bucket('delivery_days')} AS bucket_no, count(*) AS orders FROM delivered GROUP BY ALL),
base AS (SELECT count(*) AS everything, max(delivery_days) AS longest FROM delivered)"""

_MONTHLY = """monthly AS (
    SELECT purchase_month, count(*) AS orders_count, count(*) FILTER (is_late) AS late_orders_count
    FROM delivered GROUP BY ALL)"""



def _spread(name: str, column: str) -> str:
    return ", ".join(f"{cont(column, point)} AS p{point * 100:g}_{name}_days" for point in (0.1, 0.5, 0.9))


SLA = {
    "a8_stage_spread": f"""
        SELECT purchase_month, customer_state, count(*) AS orders_count, {_spread('approve', 'approve_hours / 24')},
               {_spread('handover', 'handover_days')}, {_spread('transit', 'transit_days')}
        FROM delivered GROUP BY ALL""",
    "v_delivered_orders": "SELECT * EXCLUDE (promise_days) FROM delivered",
    "q02a_view_check": """
        SELECT count(*) AS total, count(*) - count(order_approved_at) AS approved_null,
               count(*) - count(order_delivered_carrier_date) AS carrier_null,
               count(*) FILTER (order_delivered_carrier_date < order_approved_at) AS handover_bad,
               count(*) FILTER (order_delivered_customer_date < order_delivered_carrier_date) AS transit_bad,
               count(*) - count(handover_days) AS handover_null, count(*) - count(transit_days) AS transit_null,
               count(*) FILTER (approve_hours < 0) AS approve_negative
        FROM delivered""",
    "q02b_overview": f"""
        SELECT {_SIZES}, {mean('delivery_days')} AS avg_delivery_days, min(delivery_days) AS min_delivery_days,
               max(delivery_days) AS max_delivery_days FROM delivered""",
    "q02c_delivery_histogram": f"""
        WITH {_DAY_BUCKETS},
        grown AS (SELECT *, CAST(sum(orders) OVER (ORDER BY bucket_no) AS BIGINT) AS upto FROM sized)
        SELECT {label('bucket_no')} AS bucket, orders, {pct('orders', 'everything')} AS pct,
               {pct('upto', 'everything')} AS cum_pct FROM grown, base ORDER BY bucket_no""",
    "q02d_lateness_histogram": f"""
        WITH sized AS (
            SELECT {bucket('days_vs_estimate', first=1, closed=True)} AS bucket_no, count(*) AS orders
            FROM delivered WHERE is_late GROUP BY ALL),
        grown AS (SELECT *, CAST(sum(orders) OVER (ORDER BY bucket_no) AS BIGINT) AS cum_orders,
                         CAST(sum(orders) OVER () AS BIGINT) AS late FROM sized)
        SELECT {label('bucket_no', first=1)} AS bucket, orders, {pct('orders', 'late')} AS pct, cum_orders,
               {pct('cum_orders', 'late')} AS cum_pct,
               {pct('orders', '(SELECT count(*) FROM delivered)')} AS pct_of_all FROM grown ORDER BY bucket_no""",
    "q02e_buffer": f"SELECT {_BUFFER} FROM delivered WHERE NOT is_late",
    "q02f_by_month": f"""
        SELECT purchase_month, {_SIZES}, {cont('promise_days', 0.5, None)} AS median_promise_days,
               {_CUSHION} AS cushion_days FROM delivered GROUP BY purchase_month ORDER BY purchase_month""",
    "q02g_promise_cut": f"WITH {_CURVE} SELECT * EXCLUDE (late_pct) FROM shares ORDER BY cut_days LIMIT 7",
    "q03_stage_p90": f"""
        SELECT purchase_month, count(*) AS orders_count,
               {rounded("quantile_cont(approve_hours, 0.9) / 24", 2)} AS p90_approve_days,
               count(*) - count(handover_days) AS diff_handover_days_count,
               {cont('handover_days', 0.9)} AS p90_handover_days,
               count(*) - count(transit_days) AS diff_transit_days_count,
               {cont('transit_days', 0.9)} AS p90_transit_days, {cont('delivery_days', 0.9)} AS p90_delivery_days
        FROM delivered WHERE purchase_month >= DATE '1997-12-01' AND purchase_month < DATE '1998-05-01'
        GROUP BY purchase_month ORDER BY purchase_month""",
    "d01_days_late": f"""
        SELECT {cont('days_vs_estimate', 0.5)} AS median_days_late, {cont('days_vs_estimate', 0.9)} AS p90_days_late,
               max(days_vs_estimate) AS max_days_late FROM delivered WHERE is_late""",
    "d02_promise_days": f"""
        SELECT {cont('promise_days', 0.5)} AS median_promise_days, {cont('promise_days', 0.9)} AS p90_promise_days
        FROM delivered""",
    "d03_cut_check": f"""
        WITH {_CURVE}
        SELECT counted, on_curve, counted = on_curve AS agree
        FROM (SELECT count(*) AS counted FROM delivered WHERE NOT is_late AND -days_vs_estimate <= 6),
             (SELECT max(will_be_late) AS on_curve FROM curve WHERE cut_days <= 7)""",
    "d04_mean_and_median": f"""
        WITH t AS (SELECT CAST(sum(delivery_days) AS BIGINT) AS s, count(delivery_days) AS n,
                          quantile_cont(delivery_days, 0.5) AS med FROM delivered)
        SELECT {rounded('CAST(s AS DOUBLE) / n / med', 2)} AS mean_to_median,
               {pct('(SELECT count(*) FROM delivered, t WHERE delivery_days * n < s)', 'n')} AS faster_than_mean_pct
        FROM t""",
    "d05_bucket_density": f"""
        WITH {_DAY_BUCKETS},
        wide AS (SELECT *, CAST(CASE bucket_no WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 9 WHEN 5 THEN 7
                                WHEN 6 THEN 30 ELSE longest - 60 END AS INTEGER) AS days FROM sized, base)
        SELECT {label('bucket_no')} AS bucket, days, {pct('orders', 'everything * days', 3)} AS pct_per_day
        FROM wide ORDER BY bucket_no""",
    "d06_days_per_point": f"""
        WITH {_DAY_BUCKETS},
        edged AS (SELECT *, CAST(CASE bucket_no WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 14 WHEN 4 THEN 23
                                 WHEN 5 THEN 30 WHEN 6 THEN 60 ELSE longest END AS INTEGER) AS up_to_days
                  FROM sized, base),
        stepped AS (SELECT *, up_to_days - lag(up_to_days) OVER (ORDER BY bucket_no) AS more_days FROM edged)
        SELECT {label('bucket_no')} AS bucket, up_to_days, more_days,
               {ratio('more_days * everything', 'orders * 100')} AS days_per_point FROM stepped ORDER BY bucket_no""",
    "d07_marginal_cut": f"""
        WITH {_CURVE}
        SELECT cut_days, will_be_late_pct,
               {rounded('will_be_late_pct - coalesce(lag(will_be_late_pct) OVER (ORDER BY cut_days), late_pct)', 2)}
                   AS added_points FROM shares ORDER BY cut_days LIMIT 7""",
    "d08_p97_by_month": f"""
        SELECT purchase_month, {cont('delivery_days', 0.97)} AS p97_delivery_days
        FROM delivered GROUP BY ALL ORDER BY purchase_month""",
    "d09_excess_late": f"""
        WITH {_MONTHLY},
        calm AS (SELECT orders_count AS n, late_orders_count AS l FROM monthly WHERE purchase_month = DATE '1998-10-01'),
        over AS (SELECT monthly.*, n, late_orders_count * n - orders_count * l AS e FROM monthly, calm)
        SELECT purchase_month, orders_count, late_orders_count,
               CAST(CASE WHEN e >= 0 THEN (2 * e + n) // (2 * n) ELSE -((-2 * e + n) // (2 * n)) END AS BIGINT)
                   AS excess_late FROM over ORDER BY purchase_month""",
    "d10_volume_ratio": f"""
        WITH {_MONTHLY}, stepped AS (
            SELECT *, lag(orders_count) OVER (ORDER BY purchase_month) AS before FROM monthly)
        SELECT purchase_month, orders_count, {ratio('orders_count', 'before')} AS to_previous,
               {pct('late_orders_count', 'orders_count')} AS late_orders_pct FROM stepped ORDER BY purchase_month""",
    "d10_late_spread": f"""
        WITH {_MONTHLY}, parts AS (SELECT {pct('late_orders_count', 'orders_count')} AS p FROM monthly)
        SELECT min(p) AS least_pct, max(p) AS most_pct, {rounded('max(p) / nullif(min(p), 0)', 1)} AS times_apart
        FROM parts""",
    "d12_state_concentration": f"""
        WITH states AS (SELECT customer_state, count(*) AS orders_count FROM delivered GROUP BY ALL),
        grown AS (SELECT *, CAST(sum(orders_count) OVER (ORDER BY orders_count DESC, customer_state) AS BIGINT) AS upto,
                         CAST(sum(orders_count) OVER () AS BIGINT) AS total FROM states)
        SELECT customer_state, orders_count, {pct('upto', 'total')} AS cum_pct FROM grown
        ORDER BY orders_count DESC, customer_state""",
    "d13_order_weight": f"""
        SELECT customer_state, count(*) AS orders_count, {pct('1', 'count(*)', 4)} AS points_per_order
        FROM delivered GROUP BY ALL ORDER BY customer_state""",
    "d20_transit_dominates": f"""
        SELECT is_late, count(*) AS orders_count,
               count(*) FILTER (transit_days IS NOT NULL AND
                   2 * date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date)
                   > date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date))
                   AS transit_dominates,
               {pct("transit_dominates", 'count(*)')} AS transit_dominates_pct
        FROM delivered GROUP BY ALL""",
    "d20_transit_by_cycle": f"""
        WITH strata AS (
            SELECT {bucket('delivery_days')} AS bucket_no, is_late, count(*) AS orders_count,
                   count(*) FILTER (transit_days IS NOT NULL AND
                       2 * date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date)
                       > date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date))
                       AS transit_dominates
            FROM delivered GROUP BY ALL),
        weighed AS (SELECT *, CAST(sum(orders_count) OVER (PARTITION BY bucket_no) AS BIGINT) AS stratum,
                           CAST(sum(orders_count) OVER () AS BIGINT) AS everything FROM strata)
        SELECT {label('bucket_no')} AS bucket, is_late, orders_count, transit_dominates,
               {pct('transit_dominates', 'orders_count')} AS transit_dominates_pct, {pct('stratum', 'everything')} AS stratum_pct
        FROM weighed ORDER BY bucket_no, is_late""",
    "x9_buffer_by_state": f"""
        SELECT customer_state, {_BUFFER} FROM delivered WHERE NOT is_late GROUP BY ALL ORDER BY customer_state""",
}
