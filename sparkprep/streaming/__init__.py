"""Continuous scoring of arriving rows with a saved model (SCR-2)."""
