"""Readers and writers of the document store: posts, transcripts, JSON lines, logs, folders."""
