"""Structured Streaming: closed bars, signal cycles and day rolls."""
