"""Ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import functools
import json

import numpy as np
import tiktoken

#: What the vocabulary's pre-tokenizer splits a text into (a fixed value of its kind).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_by_character() -> dict[str, int]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves, and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class TextTokens:
    """The ids that `tokenizers` gives for the same file without special tokens, whose strings are ordinary text.

    The file's merges are in the order of the ids that they make, so its tokens are ranks that `tiktoken` merges by. It
    needs no memory of words, and takes texts of any length. A test compares both libraries.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, added = held["model"], {t["content"] for t in held["added_tokens"]}
        vocab, spelt = model["vocab"], _bytes_by_character()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: merges aren't in the order of their ids")
        ranks = {bytes(spelt[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids."""
        return self.encoding.encode_to_numpy(text).astype("<u4", copy=False)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_to_numpy(text))


@functools.cache
def text_tokens(path: str) -> TextTokens:
    """One encoder for each Python worker."""
    return TextTokens(path)
