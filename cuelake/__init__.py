"""cuelake: a PySpark-native engine for timed transcripts, cues and their texts."""

__version__ = "0.1.0"
