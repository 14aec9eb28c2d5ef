"""Bars and trades over unbounded ticks."""
