"""Operators of the document-intelligence engine."""
