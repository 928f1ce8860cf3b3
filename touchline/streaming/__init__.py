"""Touchline streaming."""
