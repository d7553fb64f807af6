"""Notelake: functions."""
