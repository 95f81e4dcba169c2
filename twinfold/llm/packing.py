"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every task packs the documents it reads, in the order it reads them, so nothing is shuffled. A document's ids (its
tokens and one closing id) are first cut into whole windows. What remains, shorter than a window, may go into an open
window that has room, open a new one, or be cut: its head fills a window and its tail is placed in turn. The level array
counts the open windows by fill, and the choice is that with the smallest

    sum of the squared level counts + open windows squared / 16 + ``CUT_PRICE`` for each cut.

Nothing else decides, from the first document to the last. The second term keeps memory bounded whatever the lengths:
of all levels take that with the most windows; placing there, or cutting there, changes the first sum by at most 2, so
a window is opened only while there are at most 8 (CUT_PRICE + 1) of them.

When the task's rows end, the open windows are taken apart, the emptiest first, and their pieces are placed by the same
rule with cuts free and no new window while one is open. The ids of the one that is left are cut into lengths that are
powers of two, which need no padding. Which documents share a window depends on how the scan is cut into tasks.

Defined results: a null or empty text is the closing id alone; rows with equal doc_id are packed one by one; an empty
table gives an empty result; a null doc_id is carried through; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Price of a cut in the sum that placement minimises; the open windows of a task are at most 8 (CUT_PRICE + 1) + 1.
CUT_PRICE = 63
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[ \t-\r]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Number of each word met; a word not met before is tokenised and its ids appended to ``ids``."""

    def __init__(self, tokenizer, letters: dict[int, str]):
        self.tokenizer, self.letters = tokenizer, letters
        self.model = tokenizer.model.tokenize
        self.ids, self.ends = array("I"), array("q")

    def __missing__(self, word: str) -> int:
        low = word.lower()
        stem = low if low.isalpha() else low.rstrip(".,;:!?")
        if stem.isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):
            if stem == word:
                shown = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                self.ids.extend([t.id for t in self.model(shown)])
            else:
                # All parts are known before the word's own ids are laid down.
                for k in [self[part] for part in ((stem, low[len(stem) :]) if len(stem) < len(low) else (stem,))]:
                    self.ids.extend(self.ids[self.ends[k - 1] if k else 0 : self.ends[k]])
        else:
            self.ids.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.ends.append(len(self.ids))
        self[word] = at = len(self)
        return at


class WordTokenizer:
    """Ids of a tokenizer whose words are cut at white space, remembered by word.

    The tokenizer lower-cases and drops white space, so a text's ids are its words' ids one after another. A word of
    plain letters goes straight to the BPE model; a capitalised one, or one with closing marks, is made of such pieces;
    any other word goes through the whole tokenizer. Memory is bounded: beyond ``limit`` words, and when a task ends,
    words met less than three times are forgotten, and all of them if those are too many.
    """

    def __init__(self, path: str, limit: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters, self.limit = Tokenizer.from_file(path), byte_letters(), limit
        self.words, self.met = _Words(self.tokenizer, self.letters), np.zeros(0, np.int64)

    def forget(self, least: int = 3) -> None:
        """Keep the words met ``least`` times or more."""
        old, made = self.words, _Words(self.tokenizer, self.letters)
        keep = np.zeros(len(old), bool)
        keep[: len(self.met)] = self.met >= least
        if keep.sum() * 2 < self.limit:
            ends = np.array(old.ends, np.int64)
            counts = np.diff(ends, prepend=0)
            made.update(zip([w for w, k in old.items() if keep[k]], range(int(keep.sum()))))  # in the order of numbers
            made.ids.frombytes(np.array(old.ids, np.uint32)[np.repeat(keep, counts)].tobytes())
            made.ends.frombytes(np.cumsum(counts[keep]).tobytes())
            self.met = self.met[keep[: len(self.met)]] // 2
        else:
            self.met = np.zeros(0, np.int64)
        self.words = made

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [[w for w in _ASCII_SPACE.split(t) if w] if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.words) > self.limit:
            self.forget()
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        met = np.bincount(at, minlength=len(self.words))
        met[: len(self.met)] += self.met
        self.met = met
        ends = np.frombuffer(self.words.ends, np.int64) if len(at) else at
        stop = ends[at]
        first = np.where(at > 0, ends[at - 1], 0)
        to = np.concatenate([[0], np.cumsum(stop - first)])
        flat = np.frombuffer(self.words.ids, np.uint32)[np.repeat(first - to[:-1], stop - first) + np.arange(to[-1])] if to[-1] else np.zeros(0, np.uint32)
        del ends  # else the array could not grow
        return np.split(flat, to[np.cumsum(sizes)][:-1]) if len(split) else []

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


class Packer:
    """Sum-of-squares packing of id arrays; gives (doc, start, ids, doc_tokens, sequence, offset) pieces."""

    def __init__(self, seq_len: int, cut_price: int = CUT_PRICE, first_sequence: int = 0):
        self.size, self.price, self.next = seq_len, cut_price, first_sequence
        self.level = np.zeros(seq_len + 1, np.int64)  # open windows by fill
        self.bins: dict[int, list[list]] = {}  # fill -> windows, each a list of (doc, start, ids, doc_tokens)
        self.open = 0

    def _whole(self, pieces: Iterable[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next, at
            at += len(ids)
        self.next += 1

    def _take(self, fill: int) -> list:
        self.level[fill] -= 1
        self.open -= 1
        window = self.bins[fill].pop()
        if not self.bins[fill]:
            del self.bins[fill]
        return window

    def _put(self, window: list, fill: int) -> Iterator[tuple]:
        if fill == self.size:
            yield from self._whole(window)
        else:
            self.level[fill] += 1
            self.open += 1
            self.bins.setdefault(fill, []).append(window)

    def choose(self, rest: int, price: int, may_open: bool = True) -> int:
        """Fill of the window that ``rest`` ids, fewer than a window, go into; 0 for a new one.

        Changes of 16 times the sum are compared; of equal ones an open window comes before a new one, and an emptier
        before a fuller one.
        """
        fills = np.flatnonzero(self.level)
        if not len(fills):
            return 0
        count, reached = self.level[fills], fills + rest
        left = 16 * (1 - 2 * count)  # a window leaves its level
        place = left + 16 * (1 + 2 * self.level[np.minimum(reached, self.size)])
        full = left + 1 - 2 * self.open
        cut = left + 16 * (1 + 2 * self.level[np.maximum(reached - self.size, 0)]) + 16 * price
        change = np.where(reached < self.size, place, np.where(reached == self.size, full, cut))
        best = int(np.argmin(change))
        if may_open and 16 * (1 + 2 * self.level[rest]) + 2 * self.open + 1 < change[best]:
            return 0
        return int(fills[best])

    def _place(self, doc, start: int, ids: np.ndarray, total: int, price: int, may_open: bool = True) -> Iterator[tuple]:
        while len(ids):
            fill = self.choose(len(ids), price, may_open)
            head = min(self.size - fill, len(ids))
            window = self._take(fill) if fill else []
            yield from self._put([*window, (doc, start, ids[:head].copy(), total)], fill + head)
            start, ids = start + head, ids[head:]

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, whole = len(ids), len(ids) - len(ids) % self.size
        for start in range(0, whole, self.size):
            yield from self._whole([(doc, start, ids[start : start + self.size], total)])
        yield from self._place(doc, whole, ids[whole:], total, self.price)

    def close(self) -> Iterator[tuple]:
        while self.open > 1:
            for doc, start, ids, total in self._take(min(self.bins)):
                yield from self._place(doc, start, ids, total, 0, may_open=False)
        for fill in list(self.bins):
            held, lengths = self._take(fill), [1 << b for b in range(self.size.bit_length(), -1, -1) if fill >> b & 1]
            for length in lengths:
                window, room = [], length
                while room:
                    doc, start, ids, total = held.pop(0)
                    window.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        held.insert(0, (doc, start + room, ids[room:], total))
                    room -= min(room, len(ids))
                yield from self._whole(window)


_ready: dict[str, WordTokenizer] = {}


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, cut_price: int = CUT_PRICE) -> DataFrame:
    """Pieces of packed documents: ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers.

    ``sequence_id`` is unique over the result; ``start`` counts the document's ids before the piece and ``offset``
    the sequence's. Reruns of a task give the same pieces as long as it reads the same rows in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _ready.get(tokenizer_path) or _ready.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        packer = Packer(seq_len, cut_price, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)

        def rows(pieces: Iterable[tuple]) -> pa.RecordBatch:
            got = list(pieces)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64()), pa.array([len(p[2]) for p in got], pa.int64()),
                    pa.array([p[2].astype("<u4").tobytes() for p in got], pa.binary()), pa.array([p[3] for p in got], pa.int64()),
                    pa.array([p[4] for p in got], pa.int64()), pa.array([p[5] for p in got], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = tokens.many([t or "" for t in some.column(1).to_pylist()])
                yield rows(p for doc, own in zip(some.column(0).to_pylist(), ids) for p in packer.add(doc, np.concatenate([own, end])))
        tokens.forget()
        yield rows(packer.close())

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)
