"""Readers and writers of sequence, annotation and result files."""
