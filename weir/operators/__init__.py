"""Operators over requests, completions, tool calls and corpora."""
