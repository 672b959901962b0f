"""Texts as sequences of short byte segments, each distinct segment encoded once.

A tokenizer's ids of a text are the ids of its segments (words with the space before them, say) one after another. Segment
bounds and 64-bit segment hashes are found with numpy over blocks of about a megabyte; a worker keeps the ids of the
distinct segments it has met, up to a bound beyond which it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from tidemark.llm import hashing

#: Bytes of text that are segmented together.
BLOCK = 1 << 20
#: Distinct segments that a worker remembers.
REMEMBERED = 600_000

#: Starts of the segments of a block, from its bytes and the places where its texts start.
Segmenter = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Ids of each of some distinct segments.
Encoder = Callable[[list[bytes]], list[list[int]]]


def parts(data: np.ndarray, limit: int = BLOCK) -> list[np.ndarray]:
    """A long text cut where a run of spaces starts, which is a segment start for any segmenter here; others whole."""
    if len(data) <= limit:
        return [data]
    space, out, at = hashing.space_table(), [], 0
    while len(data) - at > limit:
        end = at + limit
        while end < len(data) and not (data[end] == 32 and not space[data[end - 1]] and data[end - 1] < 128):
            end += 1
        out.append(data[at:end])
        at = end
    if at < len(data):
        out.append(data[at:])
    return out


class SegmentCoder:
    """Ids of whole texts through remembered ids of their segments."""

    def __init__(self, segment: Segmenter, encode: Encoder, remembered: int = REMEMBERED):
        self.segment, self.encode, self.remembered = segment, encode, remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes], hashes: list[int]) -> None:
        found = self.encode(pieces)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.known.update(zip(hashes, range(len(self.ends) - 1, len(self.ends) - 1 + len(found))))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])

    def _block(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        if not len(data):
            return [np.zeros(0, np.int32)] * len(texts)
        start = self.segment(data, bounds[:-1][sizes > 0])
        end = np.append(start[1:], len(data))
        hashes = hashing.range_hashes(hashing.prefix_hashes(hashing.byte_table()[data]), start, end)
        hashes = hashing.mix(hashes + (end - start).astype(np.uint64))
        distinct, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.known) + len(keys) > self.remembered:
            self._forget()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            raw = data.tobytes()
            at = first[new]
            self._learn([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())], [keys[i] for i in new])
        slots = np.array([self.known[h] for h in keys])[codes]
        ends = self.ends
        lens = ends[slots + 1] - ends[slots]
        upto = np.cumsum(lens)
        ids = self.ids[np.repeat(ends[slots] - (upto - lens), lens) + np.arange(int(upto[-1]))]
        cuts = np.concatenate([[0], upto])[np.searchsorted(start, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def __call__(self, texts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. No more than a block and one text are held."""
        waiting: list[tuple[int, list[np.ndarray]]] = []
        size = 0
        for text in texts:
            cut = parts(text)
            if len(cut) > 1:
                yield from self._flush(waiting)
                waiting, size = [], 0
                yield np.concatenate([x for p in cut for x in self._block([p])])
                continue
            waiting.append((1, cut))
            size += len(text)
            if size >= BLOCK:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[tuple[int, list[np.ndarray]]]) -> list[np.ndarray]:
        return self._block([p for _, cut in waiting for p in cut]) if waiting else []
