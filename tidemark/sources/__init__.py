"""Readers and writers of bars, contracts and filings."""
