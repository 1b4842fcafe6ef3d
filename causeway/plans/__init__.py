"""Adapters from tables to the model, and composed analyses."""
