"""Byte-level BPE ids of whole texts, equal to those of the ``tokenizers`` library for the same file."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from tidemark.llm.segments import SegmentCoder

#: Fixed values of byte-level BPE: contractions that are segments of their own, in order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


def segment_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where segments start: runs of letters, numbers or other characters, with one space before them; contractions;
    runs of white space but for the space that the next run takes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32) if len(lead) < len(data) else data
    kind = _classes()[points]
    n = len(kind)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, texts)] = True
    first[n] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change[:n])
    ends = np.append(runs[1:], n)
    start = change.copy()
    gaps = (kind[runs] == SPACE) & ~first[ends]  # runs of white space that something of the same text follows
    last = ends[gaps] - 1
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # An apostrophe that starts a segment and stands before the letters of a contraction.
    single = runs[(kind[runs] == OTHER) & (ends - runs == 1)]
    single = single[(points[single] == 39) & start[single]]
    for p in single[~first[single + 1]].tolist():
        follow = bytes(int(c) if c < 128 and not first[p + 1 + j] or j == 0 and c < 128 else 0 for j, c in enumerate(points[p + 1 : p + 3]))
        for c in CONTRACTIONS:
            if follow.startswith(c.encode()):
                start[p + 1] = False
                start[min(p + 1 + len(c), n)] = True
                break
    return lead[np.flatnonzero(start[:n])]


class ByteBpe:
    """Ids by the file of a ``tokenizers`` byte-level BPE without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.coder = SegmentCoder(segment_starts, self._encoder(spec))

    def _encoder(self, spec: dict):
        """Merges by id where the file's merges are ranked as its ids are, else the library itself."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(as_byte[c] for c in token): i for token, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
            return lambda pieces: [self.library.encode(p.decode("utf-8"), add_special_tokens=False).ids for p in pieces]
        one = tiktoken.Encoding("segments", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda pieces: [[ranks[p]] if p in ranks else one(p) for p in pieces]

    def __call__(self, texts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """The ids of each text. A text that holds an added token's string goes through the library whole."""
        odd: list[np.ndarray | None] = []

        def plain() -> Iterator[np.ndarray]:
            for x in texts:
                found = self._added_ids(x)
                odd.append(found)
                yield x if found is None else x[:0]

        for i, ids in enumerate(self.coder(plain())):
            yield ids if odd[i] is None else odd[i]
            odd[i] = None

    def _added_ids(self, data: np.ndarray) -> np.ndarray | None:
        raw = data.tobytes()
        if not any(a in raw for a in self.added):
            return None
        return np.array(self.library.encode(raw.decode("utf-8"), add_special_tokens=False).ids, np.int32)
