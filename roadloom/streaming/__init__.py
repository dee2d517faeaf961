"""Stateful rules and exactly-once sinks on Structured Streaming."""
