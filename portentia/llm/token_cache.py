"""A bounded cache of encoded words: two generations, so that frequent words survive a turnover."""

from __future__ import annotations

from collections.abc import Callable

#: Words held per generation and worker (about 50 MB).
WORDS = 250_000


class WordCache(dict):
    """word -> encoded bytes. A missing word is looked up in the older generation, then encoded."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = WORDS):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self.put(word, found)
        return found

    def put(self, word: str, found: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
