"""Operators for preparing large text, vector and media collections. Nothing else in the library imports this package."""
