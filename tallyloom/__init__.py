"""Retail demand, forecasting and stock analytics as Spark DataFrame jobs."""
