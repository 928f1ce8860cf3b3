"""Touchline operators."""
