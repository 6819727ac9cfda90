"""Lockfiles as they arrive."""
