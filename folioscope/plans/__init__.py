"""How tables become the document model."""
