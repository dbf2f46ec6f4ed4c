"""Readers and writers of library tables, artifacts and file intake."""
