"""Readers of tables and conversation logs."""
