"""Readers: delimited text, JSON messages, measurements, and the dataset registry."""
