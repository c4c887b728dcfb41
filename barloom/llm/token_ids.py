"""Token ids of texts under a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
END_ID = 1


def vocabulary_path(name_or_path: str = VOCABULARY) -> str:
    """The place of a vocabulary file: a path, or the name of one of the installed public files."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if printable, else as the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(name_or_path: str = VOCABULARY):
    """An encoder of the file's vocabulary, one per worker.

    The file's merges are in the order of their ids, so ranks are ids, and the compiled rank encoder gives
    the ids of the `tokenizers` library (a test compares them) at about a fifth of its CPU time.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name_or_path), encoding="utf-8") as file:
        model = json.load(file)
    symbol = _bytes_of_symbols()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(symbol[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def document_ids(text: str | None, name_or_path: str = VOCABULARY, end_id: int = END_ID) -> np.ndarray:
    """The ids of a whole text (null: empty), then the end id. A special token's string is that token, as in the
    `tokenizers` library."""
    ids = encoder(name_or_path).encode(text or "", allowed_special="all")
    ids.append(end_id)
    return np.array(ids, dtype="<u4")
