"""Annotating texts as they arrive."""
