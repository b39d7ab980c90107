"""Token counts and token boundaries under a public byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts were divided before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file; special strings are ordinary text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """Text without lone surrogates, which no encoding has."""
    return text.encode("utf-8", "replace").decode("utf-8")


def count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of a text; null has none."""
    return len(encoder(path).encode_ordinary(clean(text))) if text else 0


@lru_cache(maxsize=4)
def _sizes(path: str) -> np.ndarray:
    """Bytes of each token of a vocabulary."""
    enc = encoder(path)
    out = np.zeros(enc.max_token_value + 1, np.int64)
    for token in enc._mergeable_ranks.values():
        out[token] = len(enc.decode_single_token_bytes(token))
    return out


def boundaries(text: str, path: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """Where each token begins, as character offsets, and the text's length at the end.

    A token that begins inside a character counts as beginning after it.
    """
    sizes = _sizes(path)[np.array(encoder(path).encode_ordinary(text), np.int64)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if len(text) == ends[-1]:  # a byte each
        return ends
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return begins[ends]
