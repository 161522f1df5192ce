"""Sources of the document-intelligence engine."""
