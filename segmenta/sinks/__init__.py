"""Transcripts, subtitles, JSON, review lists and diagnostics."""
