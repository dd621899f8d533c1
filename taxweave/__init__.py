"""Marketplace sales and VAT analytics as Spark DataFrame operators."""
