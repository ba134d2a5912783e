"""Retail sales-decline analytics as Spark DataFrame operators."""
