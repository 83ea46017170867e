"""Tidemill plans."""
