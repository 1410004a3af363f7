"""Structured Streaming: bars from ticks, live signals."""
