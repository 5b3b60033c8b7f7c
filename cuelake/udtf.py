"""Table functions for SQL: ``SELECT * FROM t, LATERAL transcript_sentences(t.text)`` and ``..., LATERAL transcript_cues(t.text, s, e)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cuelake.functions.text import PIECE_WORDS, RUN_ON_WORDS
from cuelake.operators.captions import Limits, proportional_drafts
from cuelake.session import struct

# The look-behind alternatives have the lengths that Python needs.
_SPLIT = re.compile(r"""(?:(?<=[.!?…])|(?<=[.!?…]["'»”’)\]]))\s+(?=["'«“‘(\[¿¡]?[A-ZÁÉÍÓÚÑÜ0-9])""")


def _sentences(text: str | None) -> Iterator[str]:
    for block in (text or "").split("\n"):
        for s in _SPLIT.split(" ".join(block.split())):
            words = s.split()
            for i in range(0, len(words), PIECE_WORDS if len(words) > RUN_ON_WORDS else max(1, len(words))):
                yield " ".join(words[i : i + PIECE_WORDS] if len(words) > RUN_ON_WORDS else words)


class _Sentences:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(_sentences(text))


class _Cues:
    def eval(self, text: str, start: float, end: float) -> Iterator[tuple[float, float, list[str]]]:
        if text and text.strip() and start is not None and end is not None:
            for a, z, lines, _, _ in proportional_drafts(text, float(start), float(end), None, Limits()):
                yield a, z, lines


def register(spark: SparkSession) -> None:
    spark.udtf.register("transcript_sentences", udtf(_Sentences, returnType=struct("sent_ix int, sentence string")))
    spark.udtf.register("transcript_cues", udtf(_Cues, returnType=struct("start_s double, end_s double, lines array<string>")))
