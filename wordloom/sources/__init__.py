"""Readers and extractors that turn scripts, subtitles, markup and dictionaries into lines of text and tables."""
