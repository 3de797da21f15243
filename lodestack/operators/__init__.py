"""Operators over pages, files, queues, histories and events: DataFrames in, DataFrames out."""
