"""Delivery-promise analytics on Spark DataFrames."""
