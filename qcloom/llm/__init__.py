"""Operators for preparing training text; see the module of each operator."""
