"""Quantide: market-volatility analytics as Spark DataFrame plans."""
