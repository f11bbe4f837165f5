"""Readers and writers of pages, corpora and word lists."""
