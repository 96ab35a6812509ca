"""Token ids of the byte-level vocabulary.

The ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json``; the same vocabulary's rank file gives
them several times as fast (a test holds both against each other).
"""

from __future__ import annotations

import base64
import re
from array import array

#: Text that the vocabulary file reads as one special id; such texts go through ``tokenizers`` itself.
SPECIAL = "<|endoftext|>"
#: Runs of white space of so many characters go through ``tokenizers``, too: the rank file's library can't follow them to a million.
LONG_BLANK = 100_000
_BLANKS = re.compile(r"\s+")


def long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in _BLANKS.finditer(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids(text) as unsigned 16-bit bytes: the vocabulary has fewer than 65,536 ids."""

    def __init__(self, json_path: str):
        import public_tokenizers
        import tiktoken

        self.json_path, self._whole = json_path, None
        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if SPECIAL in text or long_blank(text):
            return array("H", self.whole().encode(text, add_special_tokens=False).ids).tobytes()
        return array("H", self.plain(text)).tobytes()

    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return self._whole


_encoders: dict[str, Encoder] = {}


def encoder(json_path: str | None = None) -> Encoder:
    """One per worker process."""
    path = json_path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
