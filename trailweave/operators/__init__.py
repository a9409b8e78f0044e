"""Operators over observations, places, transitions and graphs."""
