"""Operators for preparing training data at scale; nothing outside imports them."""
