"""Byte-level BPE of whole texts."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: Folder of the public vocabularies, the same on every machine.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same without look-ahead, which a faster engine runs. They differ only where a run of white space stands before something else.
PLAIN = PATTERN.replace(r"|\s+(?!\S)", "")
#: White space of the split pattern, for the inside of brackets.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{SPACE}]{{2,}}")
#: The first id that the vocabulary leaves free: end of document.
END = 50_256


def spaced(texts: pa.Array) -> list[bool | None]:
    """Whether each text holds a run of white space before something else."""
    return pc.match_substring_regex(texts, f"[{SPACE}][{SPACE}][^{SPACE}]").to_pylist()


class Tokenizer:
    """Texts to ids, as bytes of uint16, and back. Strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain pieces", pat_str=PLAIN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def coder(self) -> tiktoken.Encoding:
        """The vocabulary under its own split pattern; ``ids`` gives the same."""
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, text: str | None, spaced: bool = True) -> list[int]:
        """Ids of a text. ``spaced`` may be false where ``spaced`` says so; else the text is cut where a run before something
        else ends: the pattern keeps the last blank of the run apart."""
        if not text:
            return []
        if not spaced:
            return self.plain.encode_ordinary(text)
        out, at = [], 0
        for run in RUNS.finditer(text):
            if run.end() < len(text):
                out += self.plain.encode_ordinary(text[at : run.end() - 1])
                at = run.end() - 1
        return out + self.plain.encode_ordinary(text[at:])

    def encode(self, text: str | None, spaced: bool = True) -> bytes:
        return array("H", self.ids(text, spaced)).tobytes()

    def count(self, text: str | None, spaced: bool = True) -> int:
        return len(self.ids(text, spaced))

    def decode(self, ids: np.ndarray) -> str:
        return self.plain.decode_bytes(ids.tolist()).decode("utf-8")


@lru_cache(maxsize=4)
def tokenizer(folder: str = FOLDER, name: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(os.path.join(folder, name))
