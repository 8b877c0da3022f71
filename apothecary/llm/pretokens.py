"""Cutting a text where no token of the public vocabularies crosses.

A single space between two characters that are not white space always opens
a new pre-token, and with it a new token: byte-level BPE ties the space to
the word after it, and SentencePiece pieces hold the space mark only in
front. Cutting there and counting or encoding each unit by itself gives what
the whole text gives, and units repeat far more often than texts do.
"""

from __future__ import annotations

import re

_CONTROL_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_RARE_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """The text without the single spaces between its units; ``" ".join`` restores it."""
    if "  " in text or " \n" in text or "\n " in text or text.startswith(" ") or text.endswith(" "):
        return _CUT.split(text)
    if any(c in text for c in _CONTROL_SPACES) if text.isascii() else _RARE_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


class ByteBpe:
    """A byte-level BPE vocabulary file (``.json``) with a bounded cache of encoded units.

    ``encoded`` gives a text's ids as little-endian unsigned 32-bit bytes, as
    the tokenizers library gives them without added special tokens; strings
    of special tokens inside the text become those tokens.
    """

    def __init__(self, path: str, pattern: str, cache: int = 300_000):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if model["model"]["type"] != "BPE" or model.get("normalizer") or "ByteLevel" not in json.dumps(model.get("pre_tokenizer")):
            raise ValueError("the file is no byte-level BPE vocabulary without normalisation")
        special = {x["content"]: x["id"] for x in model["added_tokens"] if x["special"]}
        to_byte = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self._encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._most = cache
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        import struct

        ids = self._encoding.encode(text, allowed_special="all", disallowed_special=())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encoded(self, text: str) -> bytes:
        first, *later = units(text)
        known = self._later
        if len(known) > self._most:
            known.clear()
        try:
            tail = b"".join([known[u] for u in later])
        except KeyError:
            for u in later:
                if u not in known:
                    known[u] = self._ids(" " + u)
            tail = b"".join([known[u] for u in later])
        return self._ids(first) + tail


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
