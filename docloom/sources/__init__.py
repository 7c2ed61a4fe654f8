"""Readers, writers and the carriers that bind plain tables to the document model."""
