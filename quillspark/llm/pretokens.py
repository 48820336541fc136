"""The byte-level BPE pre-token pattern, vectorised over the characters of many texts.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Classes of characters are looked up in a table, and the starts of pre-tokens follow from the classes of
neighbours alone: a run of one class is one pre-token; the last character of a white-space run joins the
following run if it is a space, and stands alone if it is not; a run that begins with an apostrophe right
after a non-space may be a contraction.
"""

from __future__ import annotations

import base64
import sys
import unicodedata

import numpy as np

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary is by default; every function takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_TABLE: list[np.ndarray] = []
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encoding(ranks: dict[bytes, int]):  # noqa: ANN201
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def classes() -> np.ndarray:
    if not _TABLE:
        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        # categories above plane 3 are unassigned, private or marks, apart from nothing that matters here
        for c in range(0x40000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                t[c] = LETTER
            elif k == "N":
                t[c] = NUMBER
        t[_WHITE] = SPACE
        _TABLE.append(t)
    return _TABLE[0]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts, and the texts' offsets."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start; a text's offset is always among them unless it is empty."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    run = edge[:-1].copy()  # starts of runs of one class
    run[1:] |= kind[1:] != kind[:-1]
    at = run.copy()
    white = kind == SPACE
    last = np.zeros(n, bool)  # white space right before a character of the same text that isn't
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    joins = last & (cp == 32)
    at |= last  # the last white space of a run starts a pre-token ...
    after = np.flatnonzero(joins) + 1
    at[after] = False  # ... which goes on if it is a space
    apostrophe = np.flatnonzero(run & (cp == 39))
    if len(apostrophe):
        free = apostrophe[at[apostrophe]]
        free = free[free + 1 < n]
        free = free[~edge[free + 1]]
        if len(free):
            one = cp[free + 1]
            two = np.where((free + 2 < n) & ~edge[np.minimum(free + 2, n)], cp[np.minimum(free + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            pairs = [("r", "e"), ("v", "e"), ("l", "l")]
            long = np.zeros(len(free), bool)
            for a, b in pairs:
                long |= (one == ord(a)) & (two == ord(b))
            for where, size in ((free[short], 2), (free[long], 3)):
                at[where + 1] = False  # the letter belongs to the contraction
                end = where + size
                end = end[end < n]
                at[end] |= True  # what follows starts anew
                if size == 3:
                    at[where + 2] = False
            # a space-joined run can't start inside a contraction, so nothing else changes
    return np.flatnonzero(at)
