"""Public tokenizers: a rank file and a pattern, whose path is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Where a text is cut before pairs of bytes are merged: the pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_file(path: str | None = None) -> str:
    return path or os.path.join(TOKENIZERS, RANKS)


def shipped(spark: SparkSession, path: str | None) -> str:
    """The path of a rank file, which is sent to all workers, so that those without it find it as well."""
    path = rank_file(path)
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


#: Characters of lines that a worker remembers.
MEMORY = 12_000_000


class Tokenizer:
    """Token ids of texts, and for each id its bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int32)
        #: begins with a blank, so that a word begins with the token wherever it stands
        self.opens = np.zeros(size, bool)
        for b, i in ranks.items():
            self.length[i] = len(b)
            self.opens[i] = b[:1] in (b" ", b"\n")

        self.known: dict[str, np.ndarray] = {}
        self.room = MEMORY

    def _line(self, line: str) -> np.ndarray:
        """Token ids of a line; lines that come again aren't encoded again."""
        ids = self.known.get(line)
        if ids is None:
            ids = np.array(self.encoding.encode_ordinary(line), np.int32)
            self.room -= len(line) + 60
            if self.room < 0:
                self.known.clear()
                self.room = MEMORY
            self.known[line] = ids
        return ids

    def _lines(self, text: str) -> list[np.ndarray]:
        """Token ids line by line. A line begins with the line end before it, where that is the last of the white space: there the pattern always cuts."""
        out, held = [], ""
        for i, part in enumerate(text.split("\n")):
            if i == 0:
                held = part
            elif part and not part[0].isspace():
                out.append(self._line(held))
                held = "\n" + part
            else:
                held += "\n" + part
        out.append(self._line(held))
        return out

    def encode(self, text: str) -> np.ndarray:
        """Token ids."""
        lines = self._lines(text)
        return lines[0] if len(lines) == 1 else np.concatenate(lines)

    def count(self, text: str) -> int:
        return sum(map(len, self._lines(text)))


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker and file; the file is taken from where it is, else from what was sent."""
    return Tokenizer(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
