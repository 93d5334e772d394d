"""Demand forecast, anomaly detection, clustering and scenarios."""
