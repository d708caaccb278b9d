"""Readers and writers: captures, corpus, notes, observations and exhibits."""
