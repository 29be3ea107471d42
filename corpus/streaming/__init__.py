"""Resumable reading of files as they come."""
