"""Timed text at corpus scale on Spark: cues, words, speech spans, levels, documents and streams."""
