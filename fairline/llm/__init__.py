"""Operators for preparing training text, each with a query over the documents table.

Nothing else in the library imports this subpackage; it imports general helpers only.
"""
