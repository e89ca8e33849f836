"""Backtests, registered queries and their comparison SQL."""
