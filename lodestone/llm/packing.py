"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to the shortest window that holds them (256, 512, 1024 or 2048 tokens); longer ones give full
windows of 2048 first. Windows are opened from the longest tier down; a window's gap is filled with the largest pieces of
shorter tiers that fit, and what is still open with a cut piece. Every window ends up full, so nothing is padded; at the
end of a partition the rest is cut at powers of two. Sequences of one length are dealt to step groups of equal tokens.

Everything happens where a document is read: no shuffle, a bounded buffer of tokens in memory, and a lost task is redone
with the same result, since its rows depend on its own input split only.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.common import in_arrow, slices, words

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 8 * TIERS[-1]
END_ID = 1
LONGEST = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds:
    """Ids of words that stand between white space, remembered for `most` words of LONGEST letters or less.

    The tokenizer drops white space and cuts there first, so a text's ids are those of its words in a row. A word of
    Latin-1 letters, with or without punctuation behind it, is one or two pre-tokens: these go to the model directly,
    which is faster than the whole tokenizer; all other words pass the tokenizer as they are. lower: whether the
    tokenizer lower-cases.
    """

    def __init__(self, path: str, most: int = 400_000, lower: bool = True) -> None:
        from tokenizers import Tokenizer

        self.whole, self.lower = Tokenizer.from_file(path), lower
        self.model = self.whole.model
        self.most, self.known = most, {}
        self.simple = re.compile(f"([{LATIN}]+)([.,!?;:]*)").fullmatch
        letters = byte_letters()
        self.map = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

    def remember(self, part: str, got: tuple[int, ...]) -> tuple[int, ...]:
        if len(part) <= LONGEST:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[part] = got
        return got

    def core(self, part: str) -> tuple[int, ...]:
        """Of letters, or of punctuation: one pre-token."""
        got = self.known.get(part)
        return self.remember(part, tuple(t.id for t in self.model.tokenize(part.translate(self.map)))) if got is None else got

    def ids(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is not None:
            return got
        if m := self.simple(word):
            return self.core(m[1].lower() if self.lower else m[1]) + (self.core(m[2]) if m[2] else ())
        return self.remember(word, tuple(self.whole.encode(word, add_special_tokens=False).ids))

    def batch(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by `end`, and where each text's ids start."""
        w = words(texts, lower=False)
        each = [self.ids(x) for x in w.vocab.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        n = size[w.codes]
        at = np.concatenate([[0], np.cumsum(n)])
        took = np.repeat(first[w.codes] - at[:-1], n) + np.arange(at[-1])
        starts = at[w.starts]
        ids = flat[took]
        if end is not None:
            ids = np.insert(ids, starts[1:], end)
            starts = starts + np.arange(len(starts))
        return ids.astype("<u4"), starts


_shared: dict[str, WordIds] = {}


def word_ids(path: str, lower: bool = True) -> WordIds:
    """One WordIds for each Python worker and tokenizer."""
    if path not in _shared:
        _shared[path] = WordIds(path, lower=lower)
    return _shared[path]


def fill_windows(sizes: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Cuts documents of these sizes into pieces and packs them: (window length, [(document, start, length)])."""
    top = TIERS[-1]
    tiers: list[list[tuple[int, int, int]]] = [[] for _ in TIERS]  # of each tier (length, document, start), ascending
    for d, n in enumerate(sizes):
        at = 0
        while n - at >= top:
            yield top, [(d, at, top)]
            at += top
        if n > at:
            tiers[bisect.bisect_left(TIERS, n - at)].append((n - at, d, at))
    for items in tiers:
        items.sort()
    for t in range(len(TIERS) - 1, -1, -1):
        items = tiers[t]
        while items:
            n, d, at = items.pop()
            window, held = [(d, at, n)], n
            while held < TIERS[t]:
                gap, best = TIERS[t] - held, None
                for s in range(min(t, bisect.bisect_left(TIERS, gap)), -1, -1):
                    if (i := bisect.bisect_right(tiers[s], (gap, len(sizes), 0)) - 1) >= 0:
                        best = (s, i)
                        break
                if best is None:  # none fits: the smallest piece there is is cut
                    s = next((s for s in range(t + 1) if tiers[s]), None)
                    if s is None:
                        break
                    best = (s, 0)
                n, d, at = tiers[best[0]].pop(best[1])
                take = min(n, gap)
                window.append((d, at, take))
                held += take
                if n > take:
                    bisect.insort(tiers[bisect.bisect_left(TIERS, n - take)], (n - take, d, at + take))
            if held == TIERS[t]:
                yield held, window
                continue
            while window:  # the last of all: powers of two, the largest first
                size = 1 << (held.bit_length() - 1)
                part, left = [], size
                while left:
                    d, at, n = window.pop(0)
                    take = min(n, left)
                    part.append((d, at, take))
                    left -= take
                    if n > take:
                        window.insert(0, (d, at + take, n - take))
                held -= size
                yield size, part


def pack_documents(docs: DataFrame, path: str, buffer_tokens: int = 1 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece of a document: see SCHEMA.

    docs needs doc_id and text; other columns are ignored. A null or empty text is its end id alone; a null doc_id stays
    null; rows that repeat are packed as often as they occur. An empty table gives no rows. Texts of any length are cut
    at window ends. Buffers hold about buffer_tokens tokens, and one text more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        enc = word_ids(path)
        number, groups = 0, dict.fromkeys(range(TIERS[-1].bit_length() + 1), 0)
        held: list[tuple[object, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, tokens
            rows = []
            for size, pieces in fill_windows([len(x) for _, x in held]):
                k = size.bit_length() - 1
                offset, group = 0, (groups[k] * size // STEP_TOKENS << 4) + k
                groups[k] += 1
                for d, at, n in pieces:
                    doc, ids = held[d]
                    rows.append((doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), base + number, offset, size, base + group))
                    offset += n
                number += 1
            held, tokens = [], 0
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                ids, starts = enc.batch(b.column("text"), END_ID)
                for i, doc in enumerate(b.column("doc_id").to_pylist()):
                    held.append((doc, ids[starts[i] : starts[i + 1]]))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").transform(in_arrow, run, SCHEMA)
