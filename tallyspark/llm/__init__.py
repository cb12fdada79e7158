"""Operators for preparing training text: each module holds one operator and states its contract."""
