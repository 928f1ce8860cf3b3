"""Touchline sources."""
