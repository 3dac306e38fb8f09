"""Readers and writers of the file layouts the engine works with."""
