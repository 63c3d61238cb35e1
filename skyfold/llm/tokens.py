"""Byte-level BPE with the files of a public tokenizer; their folder is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

SPECIAL = "<|endoftext|>"
DEFAULT = "byte_bpe_50k"


def folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{DEFAULT}.json"))


@functools.lru_cache(2)
def _ranks(where: str, name: str) -> dict[bytes, int]:
    with open(f"{where}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(2)
def _fast(where: str, name: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(where, name), special_tokens={})


@functools.lru_cache(2)
def _file(where: str, name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{where}/{name}.json")


def encode(text: str, where: str, name: str = DEFAULT) -> np.ndarray:
    """The ids that the tokenizer file gives for the whole text, without added special tokens, as uint32.

    The rank file of the same vocabulary gives the same ids some four times as fast.  It has no special token, so a text
    with that token's string goes to the tokenizer file.
    """
    if SPECIAL in text:
        return np.array(_file(where, name).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_fast(where, name).encode_ordinary(text), np.uint32)


@functools.lru_cache(2)
def byte_lengths(where: str, name: str = DEFAULT) -> np.ndarray:
    """The bytes that each id stands for, the special token's id last."""
    ranks = _ranks(where, name)
    out = np.zeros(len(ranks) + 1, np.int64)
    for token, i in ranks.items():
        out[i] = len(token)
    out[len(ranks)] = len(SPECIAL)
    return out
