"""Readers, writers and persisted models."""
