"""Scans, filters, joins, row changes and constraint checks: DataFrame to DataFrame."""
