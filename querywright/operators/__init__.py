"""Catalogs and diagnostics over DataFrames of SQL text."""
