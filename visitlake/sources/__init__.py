"""Readers and writers: browser files, landed raw tables, the store, CSV."""
