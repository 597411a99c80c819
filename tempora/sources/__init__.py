"""Readers of transcripts, logs, traces, replies and samples."""
