"""Notelake: sources."""
