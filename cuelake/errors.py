"""Kinds of failure of media, models, transcripts and services, each with the exit code of the command line."""

from __future__ import annotations


class CuelakeError(Exception):
    exit_code = 1


class ToolNotFound(CuelakeError):
    """A media tool (``ffmpeg``, ``ffprobe``) isn't installed."""

    exit_code = 3


class MissingKey(CuelakeError):
    """A chat service is asked for without a key."""

    exit_code = 2


class RecogniserUnavailable(CuelakeError):
    """The speech model can't be imported or loaded."""

    exit_code = 6


class UndecodableMedia(CuelakeError):
    """A media file can't be decoded."""

    exit_code = 7


class InvalidTranscript(CuelakeError):
    """A file isn't a transcript."""

    exit_code = 8
