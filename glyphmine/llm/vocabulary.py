"""Vocabularies of public tokenizers; their files lie outside the repository and their paths are parameters."""

from __future__ import annotations

import base64

import tiktoken

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.tiktoken"
PIECES = f"{FOLDER}/piece_bpe_32k.model"
#: How the byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_bpe(path: str = BYTE_BPE) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
