"""Readers of SQL text: tokens, statements, files, configuration."""
