"""Weir: analytics over language-model traffic, as DataFrame plans."""
