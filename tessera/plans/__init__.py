"""Registered queries: each applies operators of this library to a fixture view."""
