"""Operators for preparing training text. Nothing else in weir imports this."""
