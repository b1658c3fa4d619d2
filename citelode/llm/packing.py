"""Packing token sequences by vector bin packing with the dot-product heuristic.

Each example has a demand vector: tokens, segments (one) and loss-bearing tokens. A sequence has a capacity in each.
The next example for the open sequence is the one whose demand has the largest dot product with the capacity left
(both scaled by the capacity). Examples may be cut: what exceeds a sequence fills sequences of its own, and where no
whole example fits the one with the largest product is cut to fill the rest. Sequences whose length is a power of two
need no padding, so a sequence that must close early is cut back to a power of two and what is left goes on.

Each input partition is packed by itself, in one pass with a buffer of bounded size: nothing is shuffled, and a lost
task makes the same sequences again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import by_value, small_batches, tidy

by_value(__name__)


@dataclass
class Packer:
    """Capacities of a sequence. add() takes examples and returns pieces (example, start, length, sequence, offset)."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    window: int = 256
    sequence: int = 0
    waiting: list = field(default_factory=list)  # [example, start, length, loss array]

    def add(self, example: object, length: int, loss: np.ndarray | None = None) -> list[tuple]:
        out, start, whole = [], 0, min(self.tokens, self.loss if loss is None else self.tokens)
        if loss is None:
            while length - start >= whole:
                out.append((example, start, whole, self.sequence, 0))
                self.sequence += 1
                start += whole
        if length > start:
            self.waiting.append([example, start, length - start, loss])
        while len(self.waiting) >= self.window:
            out += self._close()
        return out

    def finish(self) -> list[tuple]:
        out = []
        while self.waiting:
            out += self._close()
        return out

    def _lossy(self, item: list, length: int) -> int:
        return length if item[3] is None else int(item[3][item[1] : item[1] + length].sum())

    def _cut(self, item: list, room: int, loss: int) -> int:
        """The longest start of an example that fits."""
        n = min(item[2], room)
        if item[3] is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(item[3][item[1] : item[1] + n]), loss, side="right"))

    def _close(self) -> list[tuple]:
        room, slots, loss = self.tokens, self.segments, self.loss
        size = np.array([w[2] for w in self.waiting], float)
        bearing = np.array([self._lossy(w, w[2]) for w in self.waiting], float)
        free = np.ones(len(size), bool)
        chosen: list[list] = []
        while room and slots and free.any():
            score = size * room / self.tokens**2 + slots / self.segments**2 + bearing * loss / self.loss**2
            fits = free & (size <= room) & (bearing <= loss)
            i = int(np.where(fits if fits.any() else free, score, -1).argmax())
            n = int(size[i]) if fits.any() else self._cut(self.waiting[i], room, loss)
            if n == 0:
                break
            chosen.append([i, n])
            free[i] = False
            room, slots, loss = room - n, slots - 1, loss - self._lossy(self.waiting[i], n)
        fill = 1 << (sum(n for _, n in chosen).bit_length() - 1) if chosen else 0
        if self.tokens - room == self.tokens:
            fill = self.tokens
        out, taken, offset = [], {}, 0
        for i, n in chosen:
            n = min(n, fill - offset)
            if n:
                item = self.waiting[i]
                out.append((item[0], item[1], n, self.sequence, offset))
                taken[i], offset = n, offset + n
        if not out:  # one example bears more loss in a token than a sequence may
            raise ValueError("the capacities are below one token")
        self.sequence += 1
        self.waiting = [[w[0], w[1] + taken.get(i, 0), w[2] - taken.get(i, 0), w[3]] for i, w in enumerate(self.waiting) if taken.get(i, 0) < w[2]]
        return out


class Tokens:
    """Ids of texts under a tokenizers file, as little-endian unsigned 32-bit bytes.

    Where the file is a plain byte-level BPE (no normalizer, the usual split pattern, merges in the order of their ids) its
    own vocabulary also goes to a quicker library, which takes two fifths of the time. The first text of every batch is
    tokenized by the file itself as well; at the first difference the file takes over, from that batch on. Texts with
    a special token's string always go through the file."""

    #: Fixed value: the split pattern of byte-level pre-tokenizers.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact, self.quick = Tokenizer.from_file(file), None
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout"):
            vocab = model["vocab"]
            pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
            if all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(pairs)) and len(vocab) == 256 + len(model["merges"]):
                import tiktoken

                shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that the alphabet shows as they are
                alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
                ranks = {bytes([alphabet[c] for c in w]): i for w, i in vocab.items()}
                self.quick = tiktoken.Encoding("same", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_file(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.exact.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.quick is None or not texts:
            return self._by_file(texts)
        out = [None if any(s in t for s in self.special) else np.array(self.quick.encode_ordinary(t), "<u4").tobytes() for t in texts]
        if out[0] not in (None, self._by_file(texts[:1])[0]):
            self.quick = None
            return self._by_file(texts)
        return [self._by_file([t])[0] if b is None else b for t, b in zip(texts, out, strict=True)]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", end_id: int = 1, tokens: int = 2048, segments: int = 128, window: int = 256) -> DataFrame:
    """Pieces of all rows: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every token bears loss, so that
    limit is the one on tokens; the one on segments is below the window, so it holds where many examples are short.

    A null text counts as empty and gives the end id alone; a null key stays null; rows with the same key are
    examples of their own. sequence_id is the input partition times 2 ** 36 plus a counter."""
    small_batches(docs.sparkSession, 256)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as public

        encode = Tokens(public.path(f"{vocabulary}.json"))
        packer = Packer(tokens, segments, tokens, window, sequence=TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4").tobytes()

        def rows(pieces: list[tuple]) -> list[tuple]:
            return [(k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, seq, at) for (k, ids), start, n, seq, at in pieces]

        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            out: list[tuple] = []
            for k, ids in zip(b["key"].astype(object), encode([t or "" for t in b["text"]]), strict=True):
                ids += end
                out += rows(packer.add((None if k is pd.NA or k != k else k, ids), len(ids) // 4))
            yield pd.DataFrame(out, columns=names).astype({"key": object})
        yield pd.DataFrame(rows(packer.finish()), columns=names).astype({"key": object})
        del encode, packer
        tidy()

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return got.withColumnRenamed("key", key)


def pack_examples(df: DataFrame, key: str, ids: str, loss_mask: str, tokens: int = 2048, segments: int = 128, loss: int = 2048) -> DataFrame:
    """Instruction data: ids (array<int>) and loss_mask (array<int>, 1 where a token bears loss; null: all do).
    Returns key, start, length, loss_tokens, sequence_id, offset. Null or empty ids give no piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(tokens, segments, loss, sequence=TaskContext.get().partitionId() << 36)

        def rows(pieces: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(k, s, n, int(m[s : s + n].sum()), q, at) for (k, m), s, n, q, at in pieces], columns=["key", "start", "length", "loss_tokens", "sequence_id", "offset"]).astype({"key": object})

        for b in batches:
            out: list[tuple] = []
            for k, i, m in zip(b["key"].astype(object), b["ids"], b["mask"], strict=True):
                n = 0 if i is None else len(i)
                if n:
                    mask = np.ones(n, np.int64) if m is None else np.asarray(m, np.int64)
                    out += packer.add((k, mask), n, mask)
            yield rows(out)
        yield rows(packer.finish())

    key_type = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids"), F.col(loss_mask).alias("mask")).mapInPandas(run, f"key {key_type}, start long, length long, loss_tokens long, sequence_id long, offset long").withColumnRenamed("key", key)
