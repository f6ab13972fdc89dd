"""Readers and writers of sequence, structure and report files."""
