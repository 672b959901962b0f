"""SentencePiece-style unigram encoding and decoding (operator 8).

Pieces with log scores stand in a double-array trie over UTF-8 bytes, a space standing for the whitespace marker. The best
segmentation of a text is found by Viterbi. No piece goes on across the start of a run of spaces, so a text
falls apart into words whose best segmentations are independent: the distinct words of a block are segmented
together with numpy, a column of bytes at a time; very long words go alone by the same recurrence. Characters without a
piece become their bytes. Where two ways score the same, the one whose last piece starts first wins.

The scores are those of the vocabulary file. A file made for byte-pair merges states ranks as scores, and they are
taken as log scores as they are; ids then differ from those of the merge algorithm, and decoding is unaffected.

Defined results: a null or empty text has no ids; the marker character in a text is read as a space, as the format
defines; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_rows
from tidemark.llm.segments import SegmentCoder

#: Fixed value of the format: the whitespace marker.
MARKER = "▁"
#: Words of more bytes than this are segmented alone.
LONG = 64
#: The penalty of a character without a piece, below the least score.
UNKNOWN = 10.0


@dataclass
class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c if check[t] = s. value: the piece, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][c]
            values[at] = value
        size = 4 * len(children) + (1 << 16)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, queue, free, wide = [0] * len(children), [0], 257, 257  # any code fits below; wide: where states with several children are tried
        for node in queue:
            state = place[node]
            value[state] = values[node]
            if not children[node]:
                continue
            codes = sorted(children[node])
            while used[free]:
                free += 1
            b = max(1, (free if len(codes) == 1 else max(free, wide)) - codes[0])
            tries = 0
            while any(used[b + c] for c in codes):
                b += 1
                tries += 1
            if tries > 20:
                wide = b + codes[0]
            base[state] = b
            for c in codes:
                child = children[node][c]
                place[child] = b + c
                used[b + c] = 1
                check[b + c] = state
                queue.append(child)
        return cls(base, check, value)


class Unigram:
    """Encoding and decoding by pieces with log scores."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown_id: int, special: set[int]):
        self.pieces, self.byte_ids, self.unknown_id = pieces, byte_ids, unknown_id
        plain = {p.replace(MARKER, " ").encode(): i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values() and i != unknown_id and p}
        self.trie = DoubleArray.build(plain)
        self.scores = np.array(scores, float)
        self.longest = max(map(len, plain), default=1)
        self.unknown_score = min((scores[i] for i in plain.values()), default=0.0) - UNKNOWN
        self.crosses = any(b" " in k.lstrip(b" ") for k in plain)
        self.surface: list[bytes] = [b""] * len(pieces)
        for k, i in plain.items():
            self.surface[i] = k
        for byte, i in byte_ids.items():
            self.surface[i] = bytes([byte])
        self.coder = SegmentCoder(self.starts, self.encode_words)

    @classmethod
    def load(cls, path: str) -> Unigram:
        """From a SentencePiece model file; only its vocabulary is read."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if m.is_byte(i)}
        special = {i for i in range(n) if m.is_control(i) or m.is_unused(i)}
        return cls(pieces, [m.get_score(i) for i in range(n)], byte_ids, m.unk_id(), special)

    def starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Segments start with a text and, unless a piece crosses there, with a run of spaces."""
        first = np.zeros(len(data), bool)
        first[texts] = True
        if not self.crosses:
            gap = data == 32
            first[1:] |= gap[1:] & ~gap[:-1]
        return np.flatnonzero(first)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.viterbi(w)
            else:
                by_size.setdefault(-(-len(w) // 4) * 4, []).append(i)
        for width, rows in by_size.items():
            for at in range(0, len(rows), 1 << 14):
                self._columns(words, rows[at : at + (1 << 14)], width, out)
        return out  # type: ignore[return-value]

    def viterbi(self, text: bytes) -> list[int]:
        """One text alone: the plain recurrence."""
        n = len(text)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(n):
            if best[i] == -np.inf:
                continue
            lead = text[i]
            char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, alone = 0, False
            for j in range(i, min(n, i + self.longest)):
                to = int(base[state]) + text[j]
                if to >= len(check) or check[to] != state:
                    break
                state = to
                v = int(value[to])
                if v >= 0:
                    alone |= j + 1 - i == char
                    total = best[i] + float(scores[v])
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = total, i, v
            end = min(i + char, n)
            if not alone and best[i] + self.unknown_score > best[end]:
                best[end], back[end], piece[end] = best[i] + self.unknown_score, i, -1
        out: list[int] = []
        at = n
        while at > 0:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[back[at] : at]))
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
            at = back[at]
        return out[::-1]

    def _columns(self, words: list[bytes], rows: list[int], width: int, out: list) -> None:
        """Viterbi of many words at once, a column of bytes after another."""
        n = len(rows)
        size = np.array([len(words[i]) for i in rows])
        text = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(n, width).astype(np.int32)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int16), np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            live = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(live):
                continue
            lead = text[live, i]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            alone = np.zeros(n, bool)
            state, at, left = np.zeros(len(live), np.int32), live, char
            for j in range(i, min(width, i + self.longest)):
                to = base[state] + text[at, j]
                ok = (check[np.minimum(to, len(check) - 1)] == state) & (size[at] > j) & (to < len(check))
                at, state, left = at[ok], to[ok], left[ok]
                if not len(at):
                    break
                v = value[state]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    who, v = at[hit], v[hit]
                    alone[who[left[hit] == j + 1 - i]] = True
                    total = best[who, i] + scores[v]
                    win = total > best[who, j + 1]
                    who = who[win]
                    best[who, j + 1], back[who, j + 1], piece[who, j + 1] = total[win], i, v[win]
            lost = ~alone[live]
            if lost.any():
                who, end = live[lost], np.minimum(i + char[lost], size[live[lost]])
                total = best[who, i] + self.unknown_score
                win = total > best[who, end]
                who, end = who[win], end[win]
                best[who, end], back[who, end], piece[who, end] = total[win], i, -1
        every = np.arange(n)
        pos, found, byte_steps = size.copy(), [], np.zeros(n, bool)
        while (pos > 0).any():
            on = pos > 0
            p = np.where(on, piece[every, pos], -2)
            byte_steps |= p == -1
            found.append(p)
            pos = np.where(on, back[every, pos], 0)
        ids = np.array(found[::-1], np.int32).T.reshape(n, -1)
        for k, i in enumerate(rows):
            out[i] = self.viterbi(words[i]) if byte_steps[k] else ids[k][ids[k] >= 0].tolist()

    def encode(self, texts: Iterator[np.ndarray], dummy_prefix: bool = True) -> Iterator[np.ndarray]:
        """Ids of each text in UTF-8; a space is put before a text that is not empty."""
        return self.coder(self._marked(x, dummy_prefix) for x in texts)

    @staticmethod
    def _marked(data: np.ndarray, dummy_prefix: bool) -> np.ndarray:
        raw = data.tobytes()
        mark = MARKER.encode()
        if mark in raw:
            raw = raw.replace(mark, b" ")
        if raw and dummy_prefix:
            raw = b" " + raw
        return np.frombuffer(raw, np.uint8)

    def decode(self, ids: np.ndarray, dummy_prefix: bool = True) -> str:
        """The text of some ids: markers become spaces, byte pieces bytes; the space put before goes."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids), n_byte_ids, and whether decoding gives the text back."""
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte_ids.values())] = True
        names = ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip"]
        for batch in batches:
            rows = [x if x is not None else np.zeros(0, np.uint8) for x in text_rows(batch.column("text"))]
            n, crc, from_bytes, same = [], [], [], []
            for data, ids in zip(rows, model.encode(iter(rows))):
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                from_bytes.append(int(is_byte[ids].sum()))
                same.append(model.decode(ids) == data.tobytes().decode("utf-8").replace(MARKER, " "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(from_bytes, pa.int64()), pa.array(same, pa.bool_())], names)

    return d.mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_byte_ids bigint, round_trip boolean")
