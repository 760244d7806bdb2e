"""Readers and writers of raw weekly sales, the query entry point and the table adapter."""
