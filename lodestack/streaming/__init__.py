"""Telemetry on Structured Streaming; the batch twins are in the operators."""
