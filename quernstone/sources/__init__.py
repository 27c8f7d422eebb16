"""Readers and writers of text, JSON, documents and file trees."""
