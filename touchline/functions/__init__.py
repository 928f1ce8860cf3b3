"""Touchline functions."""
