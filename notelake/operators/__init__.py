"""Notelake: operators."""
