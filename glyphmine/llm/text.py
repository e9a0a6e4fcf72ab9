"""Vectorised tokenisation of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_NOT_WORD = r"[^\pL\pM\pN_]+"
_NOT_LETTER = r"[^\pL\pM]+"
_SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = _SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces that keep the work arrays in cache."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_ids(text: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, offsets, dictionary): lower-case words of all rows as dictionary indices, and where each row begins.

    A word is a run of letters, marks, digits and underscores (letters and marks with letters_only); a null row has none.
    """
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), pattern=_NOT_LETTER if letters_only else _NOT_WORD, replacement=" ")
    lists = pc.split_pattern(pc.ascii_trim_whitespace(clean), " ")
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        real = ids != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        ids = ids[real]
    return ids, offsets, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each dictionary word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; hashes has the words of one or more texts."""
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return mix(total)
