"""Readers and writers of the text formats around the engine."""
