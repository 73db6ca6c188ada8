"""Registered queries and the rental view that they use."""
