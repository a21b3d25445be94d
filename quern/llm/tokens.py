"""Byte-level BPE ids of whole texts, one cached word at a time.

The vocabulary file is read by the ``tokenizers`` library, and its model does the merges.
Its pre-tokenizer never joins a character to a space that follows it, so a text may be cut
before each single space or line feed without changing an id. Words repeat, and their ids
are kept in a bounded cache for each Python worker; a text whose white space is of any
other kind goes through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from filecmp import cmp
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Letters, digits and white space below U+0250, as the pre-tokenizer sees them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\t-\\r \x85\xa0"

PIECES = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile("[^\x00-ɏ]")
#: Where one of these occurs, cutting before each space or line feed could change ids.
LONG_RUNS = tuple(a + b + c for a in " \n" for b in " \n" for c in " \n")
OTHER_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD_DTYPE = np.dtype("<u4")


def _printable_bytes() -> dict[int, str]:
    """Byte to the character that stands for it in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


def _whole(text: str) -> bool:
    """Whether the text has white space that only the library's own cutting handles."""
    return (
        text[-2:].isspace() and len(text) > 1
        or any(run in text for run in LONG_RUNS)
        or any(c in text for c in OTHER_SPACES)
        or not text.isascii() and any(c in text for c in WIDE_SPACES)
    )


class _Words(dict):
    """Word to the little-endian bytes of its ids; a word without leading line feed had a space."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.tokenize, self.most = tokenizer, tokenizer.model.tokenize, most
        stands = _printable_bytes()
        self.table = {c: "".join(stands[b] for b in chr(c).encode()) for c in range(0x250)}
        self.space = self.table[ord(" ")]
        self.single = {chr(c): [t.id for t in self.tokenize(self.table[c])] for c in range(128)}

    def _ids(self, word: str) -> list[int]:
        if word.isascii():  # letters, with a line feed before or one other character behind: most words
            if word.isalpha():
                return [t.id for t in self.tokenize(self.space + word)]
            if word[:-1].isalpha():
                return [t.id for t in self.tokenize(self.space + word[:-1])] + self.single[word[-1]]
            if word[:1] == "\n" and word[1:].isalpha():
                return self.single["\n"] + [t.id for t in self.tokenize(word[1:])]
        text = word if word[:1] == "\n" else " " + word
        if BEYOND.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if word.isalpha():
            return [t.id for t in self.tokenize(text.translate(self.table))]
        return [t.id for piece in PIECES.findall(text) for t in self.tokenize(piece.translate(self.table))]

    def __missing__(self, word: str) -> bytes:
        found = array("I", self._ids(word)).tobytes()
        if len(word) <= 64 and len(self) < self.most:
            self[word] = found
        return found


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    ``most_words`` bounds the cache (about 200 bytes a word); words that come later are encoded anew each time.
    """

    def __init__(self, vocabulary: str, most_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.words = _Words(self.tokenizer, most_words)
        self._line_feed = len(self.words["\n"])

    @property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text without special tokens; null and empty texts give none."""
        if not text:
            return b""
        if _whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, WORD_DTYPE).tobytes()
        words = text.replace("\n", " \n").split(" ")
        first = self.words["\n" + words[0]][self._line_feed :] if words[0] and words[0][0] != "\n" else self.words[words[0]] if words[0] else b""
        return first + b"".join(map(self.words.__getitem__, words[1:]))


def ship(spark: SparkSession, vocabulary: str) -> str:
    """Sends a vocabulary file of the driver's to all executors; the name that workers know it by."""
    name = os.path.basename(vocabulary)
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(vocabulary)
    elif not cmp(SparkFiles.get(name), vocabulary, shallow=False):
        raise ValueError(f"another vocabulary file was sent as {name}")
    return name


def local_path(name: str) -> str:
    """Where the file is: a path as it stands, a shipped name in the worker's own copy."""
    return name if os.path.isabs(name) else SparkFiles.get(name)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a shipped vocabulary; workers are reused between tasks."""
    return Encoder(local_path(vocabulary))
