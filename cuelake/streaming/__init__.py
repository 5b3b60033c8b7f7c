"""Streams of segments: interval union, silence turns and cue timing in keyed state."""
