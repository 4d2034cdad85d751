"""Hierarchical multi-length packing of token sequences (operator 1)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shortlist.llm.common import process_cache, texts_of

#: Tokens that a task holds back before it packs them.
BUFFER_TOKENS = 1_000_000
#: Different word forms whose ids a Python process remembers.
CACHE_WORDS = 300_000
PIECES = "doc_id long, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long, " \
         "tier int, step_group long"


def byte_bpe(tokenizer_file: str, ranks_file: str | None, pattern: str | None) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit bytes.

    A blank between two other characters always begins a token, so texts are cut there and the ids of a part are
    remembered. Parts not seen before go through the ranks of the same vocabulary where they are given (four times
    the speed, equal ids), and through the tokenizer itself where they hold one of its special tokens.
    """
    from tokenizers import Tokenizer

    loaded = [Tokenizer.from_file(tokenizer_file)]
    special = [t.content for t in loaded[0].get_added_tokens_decoder().values()]
    plain = None
    if ranks_file:
        loaded.clear()      # about 30 MB, seldom needed beside the ranks
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, bytes] = {}
    cut = re.compile(r"(?<=\S) (?=\S)")

    def whole(text: str) -> bytes:
        if not loaded:
            loaded.append(Tokenizer.from_file(tokenizer_file))
        return np.array(loaded[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for text in texts:
            if any(s in text for s in special):
                out.append(whole(text))
                continue
            first, *rest = cut.split(text)
            parts = [first, *[" " + p for p in rest]]
            for p in set(parts).difference(known):
                known[p] = np.array(plain.encode_ordinary(p), "<u4").tobytes() if plain else whole(p)
            out.append(b"".join([known[p] for p in parts]))
        return out

    return encode


class Tiers:
    """Packs one task's documents into full windows of the tiers' lengths (powers of two, the largest is the window)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.window, self.step_tokens = sorted(tiers), max(tiers), step_tokens
        self.lengths: list[int] = []
        self.items: dict[int, list[tuple]] = {}
        self.held = 0
        self.rows: list[tuple] = []
        self.sequences = self.groups = 0
        self.steps: dict[int, list[tuple[int, list[tuple]]]] = {}

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Whole windows of a long document leave at once; its rest waits in the tier it fits."""
        n, at = len(ids), 0
        while n - at >= self.window:
            self.close([(doc_id, at, ids[at:at + self.window], n)])
            at += self.window
        if at < n:
            self.hold((doc_id, at, ids[at:].copy(), n))

    def hold(self, item: tuple) -> None:
        n = len(item[2])
        if n not in self.items:
            insort(self.lengths, n)
            self.items[n] = []
        self.items[n].append(item)
        self.held += n

    def take(self, n: int) -> tuple:
        item = self.items[n].pop()
        if not self.items[n]:
            del self.items[n]
            self.lengths.pop(bisect_left(self.lengths, n))
        self.held -= n
        return item

    def fill(self, size: int) -> None:
        """One sequence of `size`: the longest item of its tier, then the longest shorter items that fit, then a cut."""
        parts, gap = [], size
        while gap:
            at = bisect_right(self.lengths, gap)
            if at:
                item = self.take(self.lengths[at - 1])
            else:
                doc_id, start, ids, n = self.take(self.lengths[0])
                item = (doc_id, start, ids[:gap], n)
                self.hold((doc_id, start + gap, ids[gap:], n))
            parts.append(item)
            gap -= len(item[2])
        self.close(parts)

    def drain(self, all_of_it: bool) -> None:
        """Tiers from long to short while what is held fills a window; the last tokens go to smaller powers of two."""
        while self.lengths:
            longest = self.lengths[-1]
            tier = self.tiers[bisect_left(self.tiers, longest)]
            if self.held >= tier:
                self.fill(tier)
            elif all_of_it:
                self.fill(1 << (self.held.bit_length() - 1))
            else:
                return

    def close(self, parts: list[tuple]) -> None:
        size = sum(len(p[2]) for p in parts)
        group = self.steps.setdefault(size, [])
        group.append((self.sequences, parts))
        self.sequences += 1
        if len(group) * size >= self.step_tokens:
            self.emit(self.steps.pop(size))

    def emit(self, group: list[tuple[int, list[tuple]]]) -> None:
        for number, parts in group:
            offset, size = 0, sum(len(p[2]) for p in parts)
            for doc_id, start, ids, n in parts:
                self.rows.append((doc_id, start, len(ids), ids.tobytes(), n, number, offset, size, self.groups))
                offset += len(ids)
        self.groups += 1

    def finish(self) -> None:
        """Sequences of unfinished steps share steps of equal token counts, long ones first; only the last is short."""
        self.drain(True)
        left = [(size, x) for size, xs in sorted(self.steps.items(), reverse=True) for x in xs]
        self.steps = {}
        open_groups: list[list] = []
        for size, x in left:
            fits = next((g for g in open_groups if g[0] + size <= self.step_tokens), None)
            if fits is None:
                open_groups.append(fits := [0, []])
            fits[0] += size
            fits[1].append(x)
        for _, group in open_groups:
            self.emit(group)


def pack_tokens(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None,
                end_id: int = 0, tiers: tuple[int, ...] = (128, 256, 512, 1024), step_tokens: int = 8192,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack every document, one task's documents at a time and without a shuffle.

    Documents are tokenised, end with `end_id` and are routed by length: whole windows leave at once, the rest waits in
    the smallest tier that holds it. Each tier is packed by long items first, gaps are filled with the longest items of
    shorter tiers, and with the head of one where none fits. Every sequence is therefore exactly a power of two long and
    has no padding; at most one short run of sequences per task is below the smallest tier. Sequences of a tier form
    steps of `step_tokens` tokens, left ones share mixed steps of that size.

    Returns doc_id, start, length, ids_le (ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier
    (the sequence's length) and step_group. Null and empty texts are the end id alone; a null doc_id stays null; repeated
    rows are packed once each; other columns are ignored; an empty table gives no rows. Task number and row order within
    a task fix the numbering, so a task that is run again gives the same rows.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = process_cache("byte_bpe")
        encode = known.get((tokenizer_file, ranks_file))
        if encode is None:
            encode = known[(tokenizer_file, ranks_file)] = byte_bpe(tokenizer_file, ranks_file, pattern)
        task = TaskContext.get().partitionId() << 40
        packer, end = Tiers(tiers, step_tokens), np.array([end_id], "<u4").tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                c = list(zip(*packer.rows, strict=True))
                packer.rows = []
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
                    pa.array(c[3], pa.binary()), pa.array(c[4], pa.int64()),
                    pa.array(np.array(c[5], np.int64) + task), pa.array(c[6], pa.int64()), pa.array(c[7], pa.int32()),
                    pa.array(np.array(c[8], np.int64) + task)], names=names)

        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for at in range(0, batch.num_rows, 64):
                for doc_id, tokens in zip(ids.slice(at, 64).to_pylist(), encode(texts.slice(at, 64).to_pylist()), strict=True):
                    packer.add(doc_id, np.frombuffer(tokens + end, "<u4"))
                if packer.held > BUFFER_TOKENS:
                    packer.drain(False)
                if len(packer.rows) > 2000:
                    yield from flush()
        packer.finish()
        yield from flush()

    names = [x.split()[0] for x in PIECES.split(", ")]
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, PIECES)
