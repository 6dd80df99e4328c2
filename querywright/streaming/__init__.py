"""Diagnostics of SQL files as they arrive."""
