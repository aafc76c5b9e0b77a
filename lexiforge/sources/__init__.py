"""Readers and writers for the text, pair, result and knowledge files of the pipeline."""
