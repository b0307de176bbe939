"""Readers and writers: raw files, replay files, topics, collections, model registry."""
