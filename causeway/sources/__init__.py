"""Readers of repositories and archives."""
