"""Bounded one-pass summaries of CSV, and windows of event time on Structured Streaming."""
