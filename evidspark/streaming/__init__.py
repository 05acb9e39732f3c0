"""Structured Streaming extensions over the question log and incoming documents."""
