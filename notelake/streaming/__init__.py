"""Notelake: streaming."""
