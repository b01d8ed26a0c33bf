"""Spark jobs for candle and order-fill tables."""
