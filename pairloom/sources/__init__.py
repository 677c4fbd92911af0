"""Readers, writers and integrity manifests."""
