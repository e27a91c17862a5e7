"""Streaming: the stateless front of the pipeline under Structured Streaming."""
