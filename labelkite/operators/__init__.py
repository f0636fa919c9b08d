"""Operators: functions from DataFrame to DataFrame, and fitted models."""
