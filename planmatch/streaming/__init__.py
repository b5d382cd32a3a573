"""Structured Streaming form of the session memory."""
