"""Structured Streaming: pages as they arrive, cleaned and chunked; counts over event time."""
