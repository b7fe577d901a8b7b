"""Counting and cutting in tokens of a public tokenizer. The vocabulary's path is a parameter of every caller."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken

#: Where this box keeps the vocabularies; pass another path elsewhere. All executors must see the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE parts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer stretches are encoded apart, at a space: the encoder's time grows faster than the length of a run.
PART = 20_000


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a worker process, loaded once."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """All tokens of ``text``; very long texts part by part, parts ending before a space where there is one."""
    if len(text) <= PART:
        return enc.encode_ordinary(text)
    out: list[int] = []
    a = 0
    while a < len(text):
        z = min(len(text), a + PART)
        if z < len(text):
            cut = text.rfind(" ", a + PART // 2, z)
            z = cut if cut > a else z
        out += enc.encode_ordinary(text[a:z])
        a = z
    return out
