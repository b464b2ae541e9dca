"""Texts, manifests and configuration that come from outside the tables."""
