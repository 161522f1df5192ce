"""Plans of the document-intelligence engine."""
