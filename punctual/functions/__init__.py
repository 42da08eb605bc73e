"""Column expressions shared by the operators; all run inside the JVM."""

from punctual.functions.buckets import Buckets
from punctual.functions.numbers import mean, ratio, rounded, share
from punctual.functions.times import elapsed, month_of, stage, whole_days

__all__ = [
    "Buckets", "elapsed", "mean", "month_of", "ratio", "rounded", "share", "stage", "whole_days",
]
