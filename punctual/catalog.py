"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from punctual.operators import constraints
from punctual.plans import lines, quality, reviews, sheets, sla, upkeep
from punctual.sources.model import Model

Query = Callable[[Model], DataFrame]


def _repeated_items(model: Model) -> DataFrame:
    return constraints.repeated_keys(model["order_items"], ["order_id", "order_item_id"])


QUERIES: dict[str, Query] = {
    "q00a_row_counts": quality.row_counts,
    "q00b_date_span": quality.purchase_span,
    "q00c_status_share": quality.status_shares,
    "q01a_null_profile": quality.missing_dates,
    "q01b_delivered_no_date": quality.delivered_without_date,
    "q01c_chronology": quality.date_order,
    "q01d_chronology_by_status": quality.date_order_by_status,
    "q01e_chronology_preperiod": quality.date_order_before_period,
    "q01f_review_dups": quality.review_repeats,
    "q01g_dup_pattern": quality.repeat_pattern,
    "q01h_orders_by_month": quality.orders_by_month,
    "q01i_tail_orders": quality.tail_orders,
    "q01j_shipped_total": quality.shipped_total,
    "q01k_shipped_in_period": quality.shipped_in_period,
    "q01l_stuck_age": quality.stuck_age,
    "q01m_stuck_by_year": quality.stuck_by_year,
    "q01n_sample_arithmetic": quality.sample_arithmetic,
    "v_delivered_orders": sla.view,
    "q02a_view_check": sla.view_check,
    "q02b_overview": sla.overview,
    "q02c_delivery_histogram": sla.delivery_histogram,
    "q02d_lateness_histogram": sla.lateness_histogram,
    "q02e_buffer": sla.buffer,
    "q02f_by_month": sla.by_month,
    "q02g_promise_cut": sla.promise_cut,
    "q03_stage_p90": sla.stages,
    "q04a_score_distribution": reviews.score_shares,
    "q04b_score_by_lateness": reviews.scores_by_lateness,
    "q04c_score_by_bucket_on_time": reviews.scores_by_bucket,
    "q05a_flat_orders": sheets.order_sheet,
    "q05b_month_sheet": sheets.month_sheet,
    "q05c_state_sheet": sheets.state_sheet,
    "q05d_reconciliation": sheets.reconciliation,
    "s3_primary_keys": constraints.primary_key_report,
    "s3_repeated_items": _repeated_items,
    "s4_foreign_keys": constraints.foreign_key_report,
    "s5_not_null": constraints.not_null_report,
    "d01_days_late": sla.days_late,
    "d02_promise_days": sla.promise_days,
    "d03_cut_check": sla.cut_check,
    "d04_mean_and_median": sla.mean_and_median,
    "d05_bucket_density": sla.bucket_density,
    "d06_days_per_point": sla.days_per_point,
    "d07_marginal_cut": sla.marginal_cut,
    "d08_p97_by_month": sla.slowest_by_month,
    "d09_excess_late": sla.excess_late,
    "d10_volume_ratio": sla.volume_ratio,
    "d10_late_spread": sla.late_spread,
    "d11_bad_by_lateness": reviews.bad_by_lateness,
    "d11_bad_by_bucket": reviews.bad_by_bucket,
    "d12_state_concentration": sla.state_concentration,
    "d13_order_weight": sla.order_weight,
    "d14_median_month_volume": quality.median_month_volume,
    "d15_anomalous_delivered": quality.anomalous_delivered,
    "d16_period_share": quality.period_share,
    "d17_estimate_completeness": quality.estimate_completeness,
    "d18_review_order_pairs": quality.review_order_pairs,
    "d19_tail_statuses": quality.tail_statuses,
    "d20_transit_dominates": sla.transit_dominates,
    "x1_order_freight": lines.order_freight,
    "x2_seller_handover": lines.seller_handover,
    "x3_translated_categories": lines.translated_categories,
    "x4_people": lines.people,
    "x5_delivery_by_weight": lines.delivery_by_weight,
    "x6_lanes": lines.lanes,
    "x7_order_payments": lines.order_payments,
    "x8_handover_by_payment": lines.handover_by_payment,
    "x9_buffer_by_state": sla.buffer_by_state,
    "a4_distinct_per_review": quality.distinct_per_review,
    "a4_distinct_per_status": quality.distinct_per_status,
    "a8_stage_spread": sla.stage_spread,
    "d20_transit_by_cycle": sla.transit_dominates_by_cycle,
    "s4_newest_references": constraints.newest_report,
    "x5_delivery_by_volume": lines.delivery_by_volume,
    "s2_loaded_payments": upkeep.loaded_payments,
    "s2_rejected_payments": upkeep.rejected_payments,
    "s6_refreshed_months": upkeep.refreshed_months,
    "s7_published_states": upkeep.published_states,
    "p5_clustered_months": upkeep.clustered_months,
    "j2_bucketed_months": upkeep.bucketed_months,
    "x2_bucketed_handover": upkeep.bucketed_handover,
    "x10_late_by_handover": lines.late_by_handover,
}
