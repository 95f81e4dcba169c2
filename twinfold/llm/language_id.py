"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways of cutting it into pieces, of the product of their probabilities (a forward algorithm), and a text's
score for a language is the sum over its words. The piece probabilities are trained by expectation-maximisation
(forward-backward) on all words of a bounded sample of labelled documents; scoring then runs over every whole text
in one pass without a shuffle. A letter is what Unicode calls one (L), so numerals and marks are none.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal language scores are won by the
first language in code-point order; without any labelled document every text is ``und``; a null doc_id is carried
through; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the training sample: documents for each language. Rounds of expectation-maximisation.
SAMPLE_DOCS, ROUNDS = 400, 2
_LETTER, _LETTERS = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+")
_FLOOR = 1e-7  # probability of a letter that no piece covers
_TOGETHER = 36  # runs up to this length are scored together, without rescaling


def piece_list(path: str) -> list[str]:
    """The vocabulary's pieces of letters, in lower case and without word-start marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for x in kept if (p := x.replace("▁", "").lower()).isalpha()})


def sample_words(labelled: DataFrame, docs_each: int = SAMPLE_DOCS) -> dict[str, dict[str, int]]:
    """Counts of the lower-case words of a hash-ordered sample of each language's documents.

    Only documents whose hash is low enough for some 1.3 docs_each a language (six deviations above it) are gathered.
    """
    known = labelled.where("text is not null and lang is not null").select("doc_id", "lang", "text").withColumn("_h", F.shiftright(F.xxhash64("doc_id", "text"), 24))  # 40 bits
    # One row a language, as the model has one column a language.
    wanted = docs_each + 6 * docs_each**0.5 + 20
    shares = labelled.where("text is not null and lang is not null").groupBy("lang").agg((F.lit(wanted) / F.count(F.lit(1)) * (1 << 40) - (1 << 39)).alias("_limit"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", "text")
    chosen = known.join(F.broadcast(shares), "lang").where(F.col("_h") <= F.col("_limit")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_each)
    counts = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word")).groupBy("lang", "word").count()
    out: dict[str, dict[str, int]] = {}
    for lang, word, n in counts.collect():
        out.setdefault(lang, {})[word] = n
    return {lang: dict(sorted(found.items())) for lang, found in out.items()}


def matches(word: str, index: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end position, (start, piece) of the pieces that end there; -1 is a character that no piece covers."""
    out: list[list[tuple[int, int]]] = []
    for end in range(1, len(word) + 1):
        here = [(start, p) for start in range(max(0, end - longest), end) if (p := index.get(word[start:end])) is not None]
        out.append(here if any(start == end - 1 for start, _ in here) else [*here, (end - 1, -1)])
    return out


class Pieces:
    """Finds all pieces in words; the last number, len(pieces), stands for a character that is no piece."""

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.count, self.found = len(pieces), ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.found.add_word(piece, i)
        if pieces:
            self.found.make_automaton()
        self.length = np.array([*map(len, pieces), 1])
        self.single = np.array(sorted(ord(p) for p in pieces if len(p) == 1), np.uint32)

    def lattice(self, words: list[str]) -> Lattice:
        joined = "".join(w + "\n" for w in words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        got = np.fromiter(chain.from_iterable(self.found.iter(joined)) if self.count else (), np.int64).reshape(-1, 2)
        letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bare = np.flatnonzero((letters != 10) & ~np.isin(letters, self.single))
        end = np.concatenate([got[:, 0], bare]) + 1
        piece = np.concatenate([got[:, 1], np.full(len(bare), self.count)])
        return Lattice(first, size, end - self.length[piece], end, piece)


class Lattice:
    """All segmentations of some words: arcs (start, end, piece) between positions of their letters."""

    def __init__(self, first: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray):
        self.first, self.last, self.positions = first, first + size, int((size + 1).sum())
        self.start, self.end, self.piece = start, end, piece
        begins = np.repeat(first, size + 1)
        self.by_end = self._steps(end - begins[start], end)
        self.by_start = self._steps(begins[start] - start, start)  # from the words' ends to their beginnings

    @staticmethod
    def _steps(level: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs of each level, sorted by position, where a position's arcs begin, and the positions."""
        order = np.lexsort((at, level))
        cuts = np.flatnonzero(np.diff(level[order], prepend=np.iinfo(np.int64).min))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            arcs = order[a:b]
            heads = np.flatnonzero(np.diff(at[arcs], prepend=-1))
            out.append((arcs, heads, at[arcs[heads]]))
        return out

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Summed probability of what lies before each position, for each column of prob (piece x column)."""
        alpha = np.zeros((self.positions, prob.shape[1]))
        alpha[self.first] = 1.0
        for arcs, heads, at in self.by_end:
            alpha[at] = np.add.reduceat(alpha[self.start[arcs]] * prob[self.piece[arcs]], heads, axis=0)
        return alpha

    def backward(self, prob: np.ndarray) -> np.ndarray:
        """The same for what lies after it in the word."""
        beta = np.zeros((self.positions, prob.shape[1]))
        beta[self.last] = 1.0
        for arcs, heads, at in self.by_start:
            beta[at] = np.add.reduceat(beta[self.end[arcs]] * prob[self.piece[arcs]], heads, axis=0)
        return beta


@dataclass
class LanguageModel:
    """langs in code-point order; probability of piece i in language k is prob[i, k], the last row the floor."""

    langs: list[str]
    index: dict[str, int]
    prob: np.ndarray
    prior: np.ndarray

    def __post_init__(self) -> None:
        self.longest, self.pieces = max(map(len, self.index), default=1), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": None}  # the finder is made where it is used

    def word(self, word: str) -> np.ndarray:
        """Log probability of a word in each language, summed over all segmentations; scaled, so any length works."""
        rows = self.prob
        alpha: list[np.ndarray | None] = [np.ones(len(self.langs))]
        log = np.zeros(len(self.langs))
        for end, here in enumerate(matches(word, self.index, self.longest), 1):
            total = alpha[here[0][0]] * rows[here[0][1]]
            for start, p in here[1:]:
                total = total + alpha[start] * rows[p]
            alpha.append(total)
            if end % 16 == 0:  # rescale what later positions still need
                top = total.copy()
                log += np.log(top)
                for at in range(max(0, end - self.longest), end + 1):
                    alpha[at] = alpha[at] / top
                for at in range(max(0, end - self.longest - 16), max(0, end - self.longest)):
                    alpha[at] = None
        return log + np.log(alpha[-1])

    def runs(self, words: list[str]) -> np.ndarray:
        """``word`` of many runs of letters at once."""
        self.pieces = self.pieces or Pieces(list(self.index))
        out = np.empty((len(words), len(self.langs)))
        short = [(r, w) for r, w in enumerate(words) if len(w) <= _TOGETHER]
        for r, w in enumerate(words):
            if len(w) > _TOGETHER:
                out[r] = self.word(w)
        for first in range(0, len(short), 4096):
            some = short[first : first + 4096]
            lattice = self.pieces.lattice([w for _, w in some])
            out[[r for r, _ in some]] = np.log(lattice.forward(self.prob)[lattice.last])
        return out


def train(samples: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS, smoothing: float = 0.05) -> LanguageModel:
    """Piece probabilities by expectation-maximisation over all segmentations of the sampled words.

    A word longer than ``_TOGETHER`` letters is learnt from in stretches of that length.
    """
    langs, finder = sorted(samples), Pieces(pieces)
    # Longer pieces start likelier, else single letters would take all the weight. Every segmentation covers all letters,
    # so a factor for each letter changes none of the shares, and keeps the products in range.
    begin, factor = 8.0 ** np.minimum(finder.length - 1, 7), 1e4**finder.length
    prob = np.full((len(pieces) + 1, len(langs)), _FLOOR)
    for k, lang in enumerate(langs):
        counts: dict[str, int] = {}
        for word, n in samples[lang].items():
            for at in range(0, len(word), _TOGETHER):
                counts[word[at : at + _TOGETHER]] = counts.get(word[at : at + _TOGETHER], 0) + n
        lattice, n = finder.lattice(list(counts)), np.array(list(counts.values()), float)
        weight = np.repeat(n, lattice.last - lattice.first + 1)  # by position
        p = begin / begin.sum()
        p[-1] = _FLOOR
        for _ in range(rounds + 1):
            scaled = (p * factor)[:, None]
            alpha, beta = lattice.forward(scaled)[:, 0], lattice.backward(scaled)[:, 0]
            whole = np.repeat(alpha[lattice.last], lattice.last - lattice.first + 1)
            share = alpha[lattice.start] * scaled[lattice.piece, 0] * beta[lattice.end] / whole[lattice.start]
            got = np.bincount(lattice.piece, share * weight[lattice.start], minlength=len(p))[:-1] + smoothing
            p = np.append(got / got.sum(), _FLOOR)
        prob[:, k] = p
    totals = np.array([sum(samples[x].values()) for x in langs], float)
    return LanguageModel(langs, {p: i for i, p in enumerate(pieces)}, prob, np.log(totals / totals.sum()) if langs else totals)


class RunScores(dict):
    """Row of each run of letters met; new ones wait in ``new`` until ``settle`` scores them together."""

    def __init__(self, model: LanguageModel):
        self.model, self.new, self.table = model, [], np.zeros((0, len(model.langs)))

    def __missing__(self, run: str) -> int:
        at = self[run] = len(self)
        self.new.append(run)
        return at

    def settle(self) -> None:
        if self.new:
            self.table = np.concatenate([self.table, self.model.runs(self.new)])
            self.new = []


class WordScores(dict):
    """Row of each word met: the sum of its runs of letters."""

    def __init__(self, model: LanguageModel):
        self.runs, self.new, self.table = RunScores(model), [], np.zeros((1024, len(model.langs)))
        self.settled = 0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append([self.runs[word]] if word.isalpha() else [self.runs[x] for x in _LETTERS.findall(word)])
        return at

    def settle(self) -> np.ndarray:
        if self.new:
            self.runs.settle()
            counts = np.fromiter(map(len, self.new), np.int64, len(self.new))
            rows = self.runs.table[np.fromiter(chain.from_iterable(self.new), np.int64, int(counts.sum()))]
            sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
            to = np.cumsum(counts)
            while self.settled + len(counts) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            several = counts > 1
            own = np.zeros((len(counts), rows.shape[1]))
            own[counts == 1] = rows[to[counts == 1] - 1]
            own[several] = sums[to[several]] - sums[to[several] - counts[several]]
            self.table[self.settled : self.settled + len(counts)] = own
            self.settled, self.new = self.settled + len(counts), []
        return self.table


def identify(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = (), cache_words: int = 300_000) -> DataFrame:
    """doc_id, the carried columns, lang_pred and score (posterior probability of lang_pred) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages: it does not grow with the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = WordScores(m)
        for batch in batches:
            names, scores = [], []
            for start in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(start, 256).to_pylist()
                if len(seen) > cache_words:
                    seen = WordScores(m)
                split = [t.lower().split() if t and m.langs and _LETTER.search(t) else [] for t in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                at = np.fromiter(map(seen.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
                table, to = seen.settle(), np.cumsum(sizes)
                for n, end in zip(sizes, to):
                    if not n:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = table[at[end - n : end]].sum(axis=0) + m.prior
                    best = int(np.argmax(total))
                    names.append(m.langs[best])
                    scores.append(1 / math.fsum(np.exp(np.clip(total - total[best], -745, 0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *carry, "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].alias("_text"), *(docs[c] for c in carry))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f.name, f.dataType) for f in rows.schema[2:]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def language_model(docs: DataFrame, vocabulary: str) -> LanguageModel:
    """Trained on text and lang of the documents outside the held-out third."""
    return train(sample_words(docs.where(~held_out(F.col("doc_id"), 3, 1))), piece_list(vocabulary))
