"""The byte-level tokenizer on executors: loaded once per Python process from a vocabulary file named by a parameter."""

from __future__ import annotations

import base64
import functools

import numpy as np


def default_path() -> str:
    """Vocabulary file of byte_bpe_50k as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str):
    """The encoder without special tokens; their strings in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id's piece."""
    table = ranks(path)
    out = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for piece, k in table.items():
        out[k] = len(piece)
    return out
