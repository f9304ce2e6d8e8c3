"""Structured Streaming: continuous scoring, audit log and monitoring."""
