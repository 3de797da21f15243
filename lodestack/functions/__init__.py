"""Column expressions; each stays inside Spark's generated code or its higher-order functions."""
