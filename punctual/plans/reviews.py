"""Queries that relate lateness and delivery time to review scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import share
from punctual.functions.buckets import DELIVERY_BUCKETS
from punctual.operators import metrics, profile
from punctual.operators.latest import review_per_order
from punctual.plans.sla import sample
from punctual.sources.model import Model


def with_review(model: Model, how: str) -> DataFrame:
    """The sample joined with one review per order; both sides meet on the order id."""
    if model.prepared is not None:
        return model.prepared() if how == "left" else model.prepared().filter("has_review")
    scores = review_per_order(model["order_reviews"]).select("order_id", "review_score")
    return sample(model).join(scores, "order_id", how)


def score_shares(model: Model) -> DataFrame:
    """Orders per score; those without a review come last."""
    shares = profile.value_shares(with_review(model, "left"), "review_score")
    return shares.orderBy(F.asc_nulls_last("review_score"))


def scores_by_lateness(model: Model) -> DataFrame:
    """Scores of late and punctual orders."""
    return metrics.score_summary(with_review(model, "inner"), "is_late")


def _on_time_buckets(model: Model) -> DataFrame:
    number = DELIVERY_BUCKETS.number(F.col("delivery_days"))
    return with_review(model, "inner").filter("is_late = false").withColumn("bucket_no", number)


def scores_by_bucket(model: Model) -> DataFrame:
    """Scores of punctual orders per delivery-time bucket."""
    summary = metrics.score_summary(_on_time_buckets(model), "bucket_no", median_digits=2).orderBy("bucket_no")
    return summary.withColumn("bucket_no", DELIVERY_BUCKETS.label(F.col("bucket_no"))).withColumnRenamed(
        "bucket_no", "bucket"
    )


def _bad_share(scored: DataFrame, by: str) -> DataFrame:
    """Share of scores of two or less."""
    bad = F.count_if(F.col("review_score") <= 2)
    return scored.groupBy(by).agg(
        F.count("*").alias("orders_count"),
        bad.alias("bad_reviews"),
        share(bad, F.count("*")).alias("bad_reviews_pct"),
    )


def bad_by_lateness(model: Model) -> DataFrame:
    """Share of bad reviews of late and punctual orders."""
    return _bad_share(with_review(model, "inner"), "is_late")


def bad_by_bucket(model: Model) -> DataFrame:
    """Share of bad reviews of punctual orders per delivery-time bucket."""
    label = DELIVERY_BUCKETS.label(F.col("bucket_no")).alias("bucket")
    return (
        _bad_share(_on_time_buckets(model), "bucket_no")
        .orderBy("bucket_no")
        .select(label, "orders_count", "bad_reviews", "bad_reviews_pct")
    )
