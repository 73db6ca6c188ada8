"""Readers and writers of the layers."""
