"""Streaming forms: chunk counts, sliding context, sessions, current state, duplicates, online tracking."""
