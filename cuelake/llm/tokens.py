"""Encoding and decoding with a public byte-level BPE vocabulary as streaming transducers (problem 8).

A text is fed in blocks. Two lookaheads are sufficient, so the encoder holds a bounded part of the text however long it is:

* the pre-tokenizer never joins anything with white space that follows it, nor a letter, digit or mark with a following
  character of another class, so the text up to the last such place in the buffer can be split as if it ended there;
* within a run that doesn't change its class (a pre-token without end) the merge list decides. The encoding of any prefix
  of a byte string is unique and its tokens but the last are an encoding of a shorter prefix. ``_Run`` therefore keeps the
  last token of every prefix; a token may follow another iff the merges of the two together give the two again. A further
  byte can only lengthen tokens that begin within the longest token's bytes (computed from the merge list) of the end, so
  what all those prefixes share is stable and is emitted.

Decoding keeps at most three bytes of an unfinished character. Null and empty texts have the empty list; strings of
special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.session import spread

#: Folder of the vocabulary files.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: The public pre-tokenizer pattern of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters read at a time, and bytes of a run of one class from which it is encoded by prefixes.
BLOCK = 1 << 16
LONG_RUN = 1 << 18


class Vocabulary:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        #: Sufficient lookahead of the merge list: no token is longer.
        self.lookahead = max(map(len, self.ranks))
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._follow: dict[tuple[int, int], bool] = {}
        tails: dict[bytes, set[int]] = {}
        for token in self.ranks:
            tails.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of the tokens that end in given bytes, longest first.
        self.tails = {k: sorted(x, reverse=True) for k, x in tails.items()}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of two tokens give these two again."""
        known = self._follow.get((a, b))
        if known is None:
            known = self._follow[a, b] = self.coder._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]
            if len(self._follow) > 500_000:
                self._follow.clear()
        return known


@lru_cache(maxsize=4)
def vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(os.path.join(folder, f"{name}.tiktoken"))


def send_vocabulary(spark: SparkSession, folder: str, name: str) -> None:
    """Send the vocabulary file to the executors, if the driver has it; else they must have the folder themselves."""
    path = os.path.join(folder, f"{name}.tiktoken")
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent and os.path.isfile(path):
        spark.sparkContext.addFile(path)
        _sent.add(key)


_sent: set[tuple[str, str]] = set()


def sent_vocabulary(folder: str, name: str) -> Vocabulary:
    """The vocabulary in a worker: the file that was sent, else that of the folder."""
    from pyspark import SparkFiles

    sent = SparkFiles.get(f"{name}.tiktoken")
    return vocabulary(os.path.dirname(sent) if os.path.isfile(sent) else folder, name)


class _Run:
    """Encoder of one pre-token that may be without end."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.data = bytearray()  # bytes not yet emitted, after the anchor token
        self.last: list[int] = [-1]  # last token of each prefix of data; at 0 the last emitted one

    def feed(self, more: bytes) -> list[int]:
        v, data, last = self.v, self.data, self.last
        for byte in more:
            data.append(byte)
            n = len(data)
            for size in (*v.tails.get(bytes(data[-2:]), ()), 1) if n > 1 else (1,):
                if size > n:
                    continue
                t = v.ranks.get(bytes(data[n - size : n]))
                if t is None:
                    continue
                before = last[n - size]
                if before == -2 or (before >= 0 and not v.may_follow(before, t)):
                    continue
                last.append(t)
                break
            else:
                last.append(-2)
        return self._stable()

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            t = self.last[end]
            out.append(t)
            end -= len(self.v.bytes[t])
        return out[::-1]

    def _stable(self) -> list[int]:
        n = len(self.data)
        if n <= 4 * self.v.lookahead:
            return []
        ends = [e for e in range(n - self.v.lookahead + 1, n + 1) if self.last[e] >= 0]
        shared = self._path(ends[0])
        for e in ends[1:]:
            other = self._path(e)
            k = 0
            while k < min(len(shared), len(other)) and shared[k] == other[k]:
                k += 1
            shared = shared[:k]
        # The last shared token stays as the anchor against which the next must be checked.
        size = sum(len(self.v.bytes[t]) for t in shared)
        if not size:
            return []
        self.last = [shared[-1], *self.last[size + 1 :]]
        del self.data[:size]
        return shared

    def finish(self) -> list[int]:
        return self._path(len(self.data))


_SPACE, _LETTER, _DIGIT, _SIGN, _UNSURE = 0, 1, 2, 3, -1


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> int:
    """Class of a character for the pre-tokenizer. Blocks where Unicode versions differ are unsure: there is no cut at
    them, which costs memory at worst, never a wrong id."""
    o = ord(c)
    if c in " \n\t\r":
        return _SPACE
    if not (0x21 <= o < 0x250 or 0x391 <= o < 0x460 or 0x5D0 <= o < 0x5EB or 0x621 <= o < 0x64B or 0x905 <= o < 0x93A or 0xE01 <= o < 0xE3B or 0x3001 <= o < 0x3100 or 0x4E00 <= o < 0x9FA6 or 0xAC00 <= o < 0xD7A4 or 0x1F300 <= o < 0x1F600) or 0x7F <= o <= 0xA0:
        return _UNSURE
    k = unicodedata.category(c)[0]
    return _UNSURE if k in "CZ" else _LETTER if k == "L" else _DIGIT if k == "N" else _SIGN


class Encoder:
    """Text in, token ids out as soon as they are stable."""

    def __init__(self, v: Vocabulary, long_run: int = LONG_RUN) -> None:
        self.v, self.long_run = v, long_run
        self.text = ""
        self.run: _Run | None = None
        self.run_class = 0

    def feed(self, more: str) -> list[int]:
        out: list[int] = []
        if self.run is not None:
            k = 0
            while k < len(more) and _class(more[k]) == self.run_class:
                k += 1
            out += self.run.feed(more[:k].encode("utf-8"))
            if k == len(more):
                return out
            out += self.run.finish()
            self.run, more = None, more[k:]
        self.text += more
        cut = self._cut()
        if cut:
            out += self.v.coder.encode_ordinary(self.text[:cut])
            self.text = self.text[cut:]
        if len(self.text) > self.long_run and self._endless():
            self.run_class = _class(self.text[-1])
            self.run = _Run(self.v)
            out += self.run.feed(self.text.encode("utf-8"))
            self.text = ""
        return out

    def _cut(self) -> int:
        """The last place where a letter, digit or mark is followed by another class; 0 if there is none."""
        t = self.text
        if len(t) < 2:
            return 0
        after = _class(t[-1])
        for i in range(len(t) - 1, 0, -1):
            before = _class(t[i - 1])
            # A mark before a letter may be the beginning of a contraction; a space belongs to what follows.
            if before != after and before in (_LETTER, _DIGIT) and after != _UNSURE:
                return i
            # No piece goes on over white space, so whatever is surely no white space itself ends before it, in any script.
            if after == _SPACE and before != _SPACE and (before == _SIGN or unicodedata.category(t[i - 1])[0] not in "CZ"):
                return i
            after = before
        return 0

    def _endless(self) -> bool:
        """Whether the buffer is one run of a class, but for a space before it."""
        t = self.text
        k = _class(t[-1])
        start = 1 if t[0] == " " else 0
        return k in (_LETTER, _DIGIT, _SIGN) and all(_class(c) == k for c in t[start:])

    def finish(self) -> list[int]:
        out = self.run.finish() if self.run is not None else []
        self.run = None
        if self.text:
            out += self.v.coder.encode_ordinary(self.text)
            self.text = ""
        return out


def encode(text: str | None, v: Vocabulary, block: int = BLOCK, long_run: int = LONG_RUN) -> list[int]:
    """Ids of a text, without special tokens; null and empty texts give the empty list."""
    if not text:
        return []
    e = Encoder(v, long_run)
    out: list[int] = []
    for i in range(0, len(text), block):
        out += e.feed(text[i : i + block])
    return out + e.finish()


class Decoder:
    """Ids in, text out: an incremental UTF-8 machine that holds the bytes of an unfinished character only."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.v.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode(ids: Iterable[int] | None, v: Vocabulary) -> str:
    if ids is None:
        return ""
    d = Decoder(v)
    return d.feed(ids) + d.finish()


def encode_column(df: DataFrame, key: str, text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """Rows ``key, ids``; one for each row of ``df``."""
    out = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent_vocabulary(folder, name)
        for b in batches:
            at = 0
            while at < b.num_rows:
                keys, lists, size = at, [], 0
                while at < b.num_rows and size < 1_000_000:
                    ids = encode(b.column(1)[at].as_py(), v)
                    lists.append(np.asarray(ids, np.int32))
                    size += len(ids)
                    at += 1
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(keys, at - keys), made.cast(schema.field(1).type)], schema=schema)

    send_vocabulary(df.sparkSession, folder, name)
    return spread(df.select(key, text)).mapInArrow(run, out)


def decode_column(df: DataFrame, key: str, ids: str = "ids", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """Rows ``key, text``: the texts of id lists; a null list gives the empty text."""
    out = T.StructType([df.schema[key], T.StructField("text", T.StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent_vocabulary(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x.as_py(), v) for x in b.column(1)], pa.string())], schema=schema)

    send_vocabulary(df.sparkSession, folder, name)
    return df.select(key, ids).mapInArrow(run, out)


def count_column(df: DataFrame, text: str = "text", name_out: str = "n_tokens", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``df`` without its text column, with the number of its tokens."""
    kept = [c for c in df.columns if c != text]
    out = T.StructType([*(df.schema[c] for c in kept), T.StructField(name_out, T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent_vocabulary(folder, name)
        for b in batches:
            sizes = [len(encode(x.as_py(), v)) for x in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(sizes, pa.int64())], schema=schema)

    send_vocabulary(df.sparkSession, folder, name)
    return spread(df.select(*kept, text)).mapInArrow(run, out)
