"""Readers and writers for logs, typed tables and result artifacts."""
