"""Tidemill functions."""
