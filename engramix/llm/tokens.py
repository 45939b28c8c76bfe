"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: Id appended to every document.
END = 2
#: Characters whose classes the two libraries' Unicode tables may differ on: everything beyond Latin and common marks.
_RARE = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")


class Encoder:
    """Ids as `tokenizers` gives them by default, so a special token's string in a text is that token. `ranks` is the same
    vocabulary for a faster library, used for texts of plain Latin characters without special strings; others go through
    `tokenizers` itself. Without ranks every text does."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self._vocabulary = vocabulary
        self._slow = None
        self._fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            with open(vocabulary, encoding="utf-8") as whole:
                self._added = [t["content"] for t in json.load(whole)["added_tokens"]]

    def __call__(self, text: str | None) -> np.ndarray:
        """The document's ids, END included; null counts as empty."""
        text = text or ""
        if self._fast is not None and (text.isascii() or not _RARE.search(text)) and not any(t in text for t in self._added):
            ids = self._fast.encode_ordinary(text)
        else:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._vocabulary)
            ids = self._slow.encode(text, add_special_tokens=False).ids
        out = np.empty(len(ids) + 1, "<u4")
        out[:-1] = ids
        out[-1] = END
        return out


@lru_cache(4)
def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary, ranks, pattern)


def public_bpe() -> tuple[str, str | None, str | None]:
    """encoder()'s arguments for the public 50k vocabulary; the files are read where they are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []
