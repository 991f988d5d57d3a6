"""Readers, writers and checks of the project tables."""
