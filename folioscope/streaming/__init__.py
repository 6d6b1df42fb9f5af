"""Structured Streaming forms of the event log's summary, the request histogram and the rate limit."""
