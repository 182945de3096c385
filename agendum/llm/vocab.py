"""Public vocabulary files read as byte tokens with ranks. The files' place is a parameter; they are never copied."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers


@lru_cache(maxsize=4)
def ranks(name: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file."""
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one letter: visible Latin-1 characters as themselves, others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level(name: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a byte-level .json file whose merges are in the order of the ids."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        model = json.load(f)
    letters, added = byte_letters(), {x["content"]: x["id"] for x in model["added_tokens"]}
    vocab = model["model"]["vocab"]
    for i, merge in enumerate(model["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab[left + right] != 256 + i:
            raise ValueError(f"{name}: merge {i} isn't token {256 + i}")
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}, added
