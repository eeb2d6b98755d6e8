"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words remembered in each Python worker; the memory starts anew beyond.
REMEMBERED = 200_000
# Words up to so many bytes are merged as they are; longer ones are first cut where no token can cross.
SHORT = 12


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files of this kind write bytes.

    Printable bytes stand for themselves, the others, in order, for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Merges by rank, with a priority queue over a doubly linked list of symbols."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.merged: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merged[ids[left] << 20 | ids[right]] = (rank, ids[left + right])
        self.token_bytes: list[bytes] = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if all(c in letters for c in token):
                self.token_bytes[i] = bytes(letters[c] for c in token)
        self.crossings = {
            (t[i - 1], t[i]) for t in self.token_bytes for i in range(1, len(t)) if not 0x80 <= t[i] < 0xC0
        }
        self.find = regex.compile(PATTERN).findall
        self.memory = _Memory(self)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word. Stale queue entries (a symbol merged since) are skipped."""
        byte_ids, merged = self.byte_ids, self.merged
        symbols = [byte_ids[b] for b in data]
        n = len(symbols)
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            hit = merged.get(symbols[i] << 20 | symbols[i + 1])
            if hit:
                queue.append((hit[0], i, symbols[i], symbols[i + 1], hit[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = merged.get(new << 20 | symbols[k])
                if hit:
                    heapq.heappush(queue, (hit[0], i, new, symbols[k], hit[1]))
            p = before[i]
            if p >= 0:
                hit = merged.get(symbols[p] << 20 | new)
                if hit:
                    heapq.heappush(queue, (hit[0], p, symbols[p], new, hit[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word; long ones are cut between characters that no token spans.

        No token holds the last byte of the one character followed by the first byte of the other, so no
        merge crosses the cut, and the parts can be merged, and remembered, on their own.
        """
        data = word.encode("utf-8", "surrogatepass")
        if len(data) <= SHORT:
            return tuple(self.merge(data))
        parts, start = [], 0
        crossings = self.crossings
        last = data[0]
        for i in range(1, len(data)):
            b = data[i]
            if not 0x80 <= b < 0xC0 and (last, b) not in crossings:
                parts.append(data[start:i])
                start = i
            last = b
        if not parts:
            return tuple(self.merge(data))
        parts.append(data[start:])
        memory = self.memory
        return tuple(chain.from_iterable(memory[p.decode("utf-8", "surrogatepass")] for p in parts))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.find(text)))) if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")


class _Memory(dict):
    """Words to ids, computed on the first sight; bounded."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.encoder.word(word)
        return ids


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The worker's encoder for a vocabulary file, read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """``key`` and ``ids array<int>`` of each row, without special tokens; map-only.

    Null and empty text give an empty list. Repeated rows give repeated rows, other columns are left out.
    """
    path = f"{tokenizer_dir.rstrip('/')}/{VOCABULARY}"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode_one = encoder(path).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                lists = [encode_one(t) for t in texts.slice(at, 256).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, 256), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"]
                )

    out = docs.select(F.col(key), F.col(text).alias("_text"))
    return out.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(
    docs: DataFrame, keep: list[str], text: str = "text", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens bigint``, the length of what :func:`encode` gives."""
    path = f"{tokenizer_dir.rstrip('/')}/{VOCABULARY}"
    types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        find, ids_of = enc.find, enc.memory.__getitem__
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes: list[int] = []
            for at in range(0, len(texts), 256):
                sizes += [sum(map(len, map(ids_of, find(t)))) if t else 0 for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64())], [*keep, "n_tokens"]
            )

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{types}, n_tokens bigint")
