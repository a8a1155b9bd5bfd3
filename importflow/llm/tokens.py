"""Token ids of a public vocabulary, read from the tokenizers library's file.

Byte-level BPE whose ids follow the order of its merges can be encoded by rank, which tiktoken does
several times faster with the same ids; other files, and texts of more than ``LONG`` characters,
go through tokenizers itself.  As there, the strings of special tokens in a text become their ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

LONG = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(path: str | None):
    """A function from texts to lists of ids."""
    from tokenizers import Tokenizer

    path = path or default_vocabulary()
    slow = Tokenizer.from_file(path)
    fast = _by_rank(path)

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            fast.encode(t, allowed_special="all") if fast and len(t) <= LONG
            else slow.encode(t, add_special_tokens=False).ids
            for t in texts
        ]

    return encode


def _by_rank(path: str):
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (
        model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
        or split.get("use_regex") is False or spec.get("normalizer") or model.get("dropout")
    ):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merged]
    if order != sorted(order):
        return None
    import public_tokenizers
    import tiktoken

    byte = _bytes_of_letters()
    ranks = {
        bytes(byte[c] for c in piece): number
        for piece, number in model["vocab"].items() if piece not in special
    }
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
