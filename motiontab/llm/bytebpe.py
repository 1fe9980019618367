"""Byte-level BPE vocabularies read from a tokenizers file, encoded through tiktoken's merge loop.

Both libraries merge by rank within the same pre-tokens, so ids agree wherever a vocabulary numbers its merges in order.
"""

from __future__ import annotations

import json

import numpy as np

#: Byte-level tokenizers write each byte as a letter: printable ones as themselves, the rest in order from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class ByteVocabulary:
    """Ids of texts by a byte-level BPE file, and the bytes of each id."""

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tiktoken_ext.openai_public import r50k_pat_str

        with open(tokenizer_file, encoding="utf-8") as f:
            told = json.load(f)
        vocab, special = told["model"]["vocab"], {t["content"]: t["id"] for t in told["added_tokens"]}
        before = told["pre_tokenizer"] or {}
        plain = told["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        if not plain or loose or told["truncation"] or told["padding"] or merged != sorted(merged):
            raise ValueError("not a plain byte-level BPE whose merges are numbered in order")
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(map(_BYTE_OF.__getitem__, token))
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        ranks = {self.bytes_of[i]: i for token, i in vocab.items() if token not in special}
        self.special = set(special)
        self.coding = tiktoken.Encoding("byte-level", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """As tokenizers gives them by default: special strings in the text are their ids."""
        return self.coding.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())

    def plain_ids(self, text: str) -> np.ndarray:
        """Special strings are plain text."""
        return self.coding.encode_to_numpy(text, disallowed_special=())


_known: dict[str, ByteVocabulary] = {}


def vocabulary(tokenizer_file: str) -> ByteVocabulary:
    if tokenizer_file not in _known:
        _known[tokenizer_file] = ByteVocabulary(tokenizer_file)
    return _known[tokenizer_file]
