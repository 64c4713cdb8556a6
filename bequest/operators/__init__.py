"""Joins, ordered scans, filters, validators and batch transitions."""
