"""Readers, writers and the views that the queries run over."""
