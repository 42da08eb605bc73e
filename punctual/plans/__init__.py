"""The queries: functions from a model to a DataFrame."""
