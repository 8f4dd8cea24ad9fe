"""Token ids from public tokenizer files."""

from __future__ import annotations

import json
from functools import cache

# Fixed value: the byte-level BPE split pattern, possessive form of the published one.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Byte-level BPE from a ``tokenizers`` JSON file, run by tiktoken: the same
    merges by rank, several times faster. Special tokens in a text get their ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.special = list(special)
        self.enc = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.enc.encode(text, allowed_special="all")
        return self.enc.encode_ordinary(text)


@cache
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
