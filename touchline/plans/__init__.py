"""Touchline plans."""
