"""Posting analytics on Spark: measure how a topic spreads through dated, firm-linked documents."""
