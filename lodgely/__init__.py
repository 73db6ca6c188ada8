"""Rental-listing data on Spark: captured pages to bronze, silver and gold tables."""
