"""Readers and writers: explicit schemas, malformed rows dropped, never fatal."""
