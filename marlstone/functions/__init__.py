"""Column functions: coercion of raw text, buckets, and small formatting helpers. All are built-in expressions."""
