"""Streaming of the document-intelligence engine."""
