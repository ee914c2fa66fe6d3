"""Relational, retrieval and telemetry operators over DataFrames."""
