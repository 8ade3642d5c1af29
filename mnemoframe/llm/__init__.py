"""Operators for the preparation of training and evaluation data."""
