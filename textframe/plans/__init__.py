"""Decisions taken on the driver from small aggregates, and order across file splits."""
