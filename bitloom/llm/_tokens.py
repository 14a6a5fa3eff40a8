"""Token ids of texts by a public tokenizer, each distinct chunk of a text encoded once.

word_bpe_49k drops white space and never joins characters across it, so a text's ids
are those of its white-space parts in turn. Parts are cut further between an ASCII
letter and ASCII punctuation: its pattern never spans such a place, unless an
apostrophe stands before it. Special tokens may span it, hence texts around "<|"
are only cut at white space.
"""

from __future__ import annotations

import os

import numpy as np

from . import _text as T

VOCABULARY = "word_bpe_49k.json"
#: Distinct chunks that a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000

_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 2
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 3
_CLASS[[32, *range(9, 14)]] = 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def chunks(s: T.Slice, fine: bool) -> T.Words:
    kind = _CLASS[s.buf]
    inside = kind > 0
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    if fine and len(kind) > 1:
        cut = np.flatnonzero((kind[1:] | kind[:-1]) == 3) + 1
        cut = cut[(kind[cut] != 3) & (kind[cut - 1] != 3) & (s.buf[cut - 1] != ord("'"))]
        begin[cut] = True
        stop[cut - 1] = True
    edge = s.at[(s.at > 0) & (s.at < len(s.buf))]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return T.Words(start, end, np.searchsorted(start, s.at))


class Encoder:
    _known: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, special_as_text: bool = False) -> Encoder:
        """One per worker, tokenizer file and way with special tokens."""
        if (path, special_as_text) not in cls._known:
            cls._known[path, special_as_text] = cls(path, special_as_text)
        return cls._known[path, special_as_text]

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.fine_always = special_as_text
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin."""
        plain = self.fine_always or b"<|" not in s.buf.tobytes()
        w = chunks(s, plain)
        h = T.HASH[0].ranges(s.buf, w.start, w.end, lower=plain)
        unique, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self._forget()
        if not plain:  # hashes of another kind
            kept, self.place = self.place, {}
        keys = unique.tolist()
        at = np.fromiter((self.place.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            low = T.LOWER[s.buf] if plain else s.buf
            raw = low.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(w.start[example[new]].tolist(), w.end[example[new]].tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))
            at[new] = len(self.start) + np.arange(len(new))
            self.place.update(zip((keys[k] for k in new.tolist()), at[new].tolist()))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, flat])
        if not plain:
            self.place = kept
        per = self.count[at][inverse]
        ids = self.ids[T.ranges(self.start[at][inverse], per)]
        return ids, np.append(0, np.cumsum(T.sums(per, w.at)))
