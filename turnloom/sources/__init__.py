"""Readers and writers of the file formats the jobs meet."""
