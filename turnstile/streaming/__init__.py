"""Structured Streaming: landing payloads and keeping the chain up to date."""
