"""Functions of the document-intelligence engine."""
