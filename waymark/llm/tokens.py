"""Public tokenizers inside tasks, loaded once per worker.

Texts are taken apart into chunks that are tokenized alike wherever they stand;
a worker gives each distinct chunk to the tokenizer once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"
#: Long texts are taken apart about this many characters at a time.
PIECE_CHARS = 1 << 20
#: A single blank between these characters begins a token of all vocabularies used here, whatever stands around.
CUT, UNFIT = re.compile(r"(?<=[!-~\w])\x20(?=[!-~\w])"), re.compile(r"(?<![!-~\w])\x20|\x20(?![!-~\w])")
#: What is known of chunks is kept in a worker up to this many of them, and this many of their characters; so many are learned at a time.
MOST_CHUNKS, MOST_CHARS, LEARNED = 1 << 18, 32 << 20, 1 << 13


def vocabulary(spark: SparkSession, path: str):
    """A vocabulary file of fixed size, read by the driver and broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def chunks(text: str, chars: int = PIECE_CHARS) -> list[str]:
    """The text's chunks, without the blanks that stand between them. Tokens never cross from one into the next."""
    out, at = [], 0
    while at <= len(text):
        cut = CUT.search(text, at + chars) if len(text) - at > chars else None
        part = text[at:cut.start() if cut else len(text)]
        out += CUT.split(part) if UNFIT.search(part) else part.split(" ")
        at = cut.end() if cut else len(text) + 1
    return out


class Chunks(dict):
    """Numbers of distinct chunks, and the tables of what is known of them, which ``learn`` adds to in order of the numbers."""

    def __init__(self, learn: Callable[[list[str]], None], most: int | None = None) -> None:
        super().__init__()
        self.learn, self.most, self.new, self.chars = learn, most or MOST_CHUNKS, [], 0

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return n

    @property
    def full(self) -> bool:
        return len(self) > self.most or self.chars > MOST_CHARS

    def numbers(self, parts: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        for i in range(0, len(self.new), LEARNED):
            self.learn(self.new[i:i + LEARNED])
        self.new = []
        return found


class Ragged:
    """Rows of numbers, added at the end."""

    def __init__(self, dtype=np.int32) -> None:
        self.values, self.begin, self.length = Grown(dtype), Grown(np.int64), Grown(np.int32)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        self.begin.add(self.values.size + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.values.add(values)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after another, and how many each has."""
        lengths = self.length.all[rows].astype(np.int64)
        place = np.arange(lengths.sum()) + np.repeat(self.begin.all[rows] - (np.cumsum(lengths) - lengths), lengths)
        return self.values.all[place], lengths


class Grown:
    """An array that is added to; its room doubles."""

    def __init__(self, dtype) -> None:
        self.room, self.size = np.empty(1 << 12, dtype), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[:self.size]

    def add(self, values) -> None:
        values = np.asarray(values, self.room.dtype)
        if self.size + len(values) > len(self.room):
            room = np.empty(2 * (self.size + len(values)), self.room.dtype)
            room[:self.size] = self.all
            self.room = room
        self.room[self.size:self.size + len(values)] = values
        self.size += len(values)


_LOADED: dict[tuple, object] = {}


def once(kind: str, content: bytes, load: Callable[[bytes], object]):
    """What ``load`` makes of a vocabulary, kept in the worker."""
    key = (kind, len(content), hash(content))
    if key not in _LOADED:
        _LOADED[key] = load(content)
    return _LOADED[key]


def bpe(content: bytes, plain_specials: bool = False):
    """A tokenizer of the tokenizers library; with ``plain_specials``, special tokens' strings in texts are ordinary text."""
    # cores are Spark's to deal out
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def load(data: bytes):
        loaded = Tokenizer.from_str(data.decode())
        loaded.encode_special_tokens = plain_specials
        return loaded

    return once(f"bpe-{plain_specials}", content, load)


def sentence_pieces(content: bytes):
    import sentencepiece

    return once("pieces", content, lambda data: sentencepiece.SentencePieceProcessor(model_proto=data))
