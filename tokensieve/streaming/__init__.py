"""Structured Streaming: compression of documents as they arrive, and throughput by window."""
