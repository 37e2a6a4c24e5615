"""Readers and writers: text trees, corpus tables, chunk files and event logs."""
