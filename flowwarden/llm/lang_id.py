"""Language identification by unigram piece models that sum over all segmentations of a text.

Pieces come from a fixed public vocabulary. Words are runs of letters in lower case with the vocabulary's word mark before
them. A word's probability in a language is the sum over all ways to cut it into pieces of the product of the pieces'
probabilities, computed by the forward algorithm; a text's is the product over its words.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces as small_batches
from .common import saved
from .textops import ORDER, mix64

UNKNOWN = "und"
MARK = "▁"
#: Words up to so many letters are summed in plain numbers, longer ones in logarithms: their sums leave the range of doubles.
PLAIN = 40
LEAST = 1e-7
SMOOTHING = 0.5
#: Numbers that a worker remembers of words it has scored, one per word and language.
CACHE_VALUES = 1_200_000
#: The commonest training words whose scores go to all workers.
COMMON_WORDS = 100_000
_UNIT = 1_000_000  # expected counts are added up as whole millionths, so their sum doesn't depend on the order
_SLICE = 1 << 20
_CELLS = 1 << 18  # places of words that are summed at once
_TABLE_BITS = 18
_M = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_file: str) -> list[str]:
    """The pieces of a public sentencepiece vocabulary in the order of their ids, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in plain]


class Lattice:
    """All pieces of the vocabulary that occur in words, for many words at once."""

    def __init__(self, vocab: list[str], mark: str = MARK):
        self.mark = mark  # stands before each word
        self.longest = max(map(len, vocab))
        self.unknown = len(vocab)  # stands for a letter that no piece has
        hashes = self._hashes(vocab)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        self.first = np.searchsorted(self.hashes >> np.uint64(64 - _TABLE_BITS), np.arange((1 << _TABLE_BITS) + 1).astype(np.uint64))
        self.probes = int(np.diff(self.first).max())

    @staticmethod
    def _step(h, c):
        h = (h ^ c) * _M
        return h ^ (h >> np.uint64(29))

    def _hashes(self, vocab: list[str]) -> np.ndarray:
        lengths = np.array([len(p) for p in vocab])
        codes = np.zeros((len(vocab), self.longest), np.uint64)
        codes[np.arange(self.longest) < lengths[:, None]] = np.frombuffer("".join(vocab).encode("utf-32-le"), np.uint32)
        h = np.zeros(len(vocab), np.uint64)
        for i in range(self.longest):
            h = np.where(i < lengths, self._step(h, codes[:, i] + np.uint64(1)), h)
        return h * _M

    def _find(self, h: np.ndarray) -> np.ndarray:
        h = h * _M
        cell = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out = np.full(len(h), -1, np.int64)
        for i in range(self.probes):
            ok = np.flatnonzero(at + i < end)
            if not len(ok):
                break
            spot = at[ok] + i
            hit = self.hashes[spot] == h[ok]
            out[ok[hit]] = self.ids[spot[hit]]
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Order of the words by length, longest first; their lengths with the mark, in that order; for each end place
        e = 1, 2, ... a list of (length, places in the order, piece ids) of the pieces that end there."""
        lengths = np.array([len(w) + len(self.mark) for w in words])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        codes = np.frombuffer("".join(self.mark + words[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        start = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        left = np.repeat(start + lengths, lengths) - np.arange(len(codes))  # letters from a place to the word's end
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes)) - start[word]
        found: list[list] = [[] for _ in range(int(lengths.max()) + 1)]
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, self.longest + 1):
            ok = left[at] >= n
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = self._step(h, codes[at + n - 1])
            ids = self._find(h)
            if n == 1:
                ids = np.where(ids < 0, self.unknown, ids)
            hit = np.flatnonzero(ids >= 0)
            ends = place[at[hit]] + n
            by_end = np.argsort(ends, kind="stable")
            hit, ends = hit[by_end], ends[by_end]
            cuts = np.searchsorted(ends, np.arange(len(found) + 1))
            for e in range(1, len(found)):
                if cuts[e + 1] > cuts[e]:
                    part = hit[cuts[e] : cuts[e + 1]]
                    found[e].append((n, word[at[part]], ids[part]))
        return order, lengths, found

    def _blocks(self, words: list[str]) -> Iterator[list[int]]:
        """Places of words of like length, of which a table with a row per letter stays small."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        block, plain = [], True
        for i in order:
            n = len(words[i])
            if block and ((len(block) + 1) * (n + 2) > _CELLS or plain != (n <= PLAIN)):
                yield block
                block = []
            plain = n <= PLAIN
            block.append(i)
        if block:
            yield block

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, a row per word and a column per column of probs[piece, model]."""
        out = np.empty((len(words), probs.shape[1]))
        logs = None
        for block in self._blocks(words):
            order, lengths, found = self.edges([words[i] for i in block])
            alpha = np.zeros((int(lengths.max()) + 1, len(block), probs.shape[1]))
            if len(alpha) <= PLAIN + len(self.mark) + 1:
                alpha[0] = 1
                for e in range(1, len(alpha)):
                    for n, word, ids in found[e]:
                        alpha[e][word] += alpha[e - n][word] * probs[ids]
                total = np.log(alpha[lengths, np.arange(len(block))])
            else:
                logs = np.log(probs) if logs is None else logs
                alpha[1:] = -np.inf
                for e in range(1, len(alpha)):
                    for n, word, ids in found[e]:
                        alpha[e][word] = np.logaddexp(alpha[e][word], alpha[e - n][word] + logs[ids])
                total = alpha[lengths, np.arange(len(block))]
            out[np.array(block)[order]] = total
        return out

    def expected(self, words: list[str], probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected, each word counting by its row of weights[word, model]; probs[piece]."""
        out = np.zeros((len(probs), weights.shape[1]))
        for block in self._blocks(words):
            order, lengths, found = self.edges([words[i] for i in block])
            size, last = int(lengths.max()) + 1, (lengths, np.arange(len(block)))
            own = weights[np.array(block)[order]]
            alpha, beta = np.zeros((size, len(block))), np.zeros((size, len(block)))
            plain = size <= PLAIN + len(self.mark) + 1
            value = probs if plain else np.log(probs)
            if not plain:
                alpha[:], beta[:] = -np.inf, -np.inf
            alpha[0], beta[last] = (1, 1) if plain else (0, 0)
            for e in range(1, size):
                for n, word, ids in found[e]:
                    if plain:
                        alpha[e][word] += alpha[e - n][word] * value[ids]
                    else:
                        alpha[e][word] = np.logaddexp(alpha[e][word], alpha[e - n][word] + value[ids])
            total = alpha[last]
            for e in range(size - 1, 0, -1):
                for n, word, ids in found[e]:
                    if plain:
                        through = beta[e][word] * value[ids]
                        beta[e - n][word] += through
                        share = alpha[e - n][word] * through / total[word]
                    else:
                        through = beta[e][word] + value[ids]
                        beta[e - n][word] = np.logaddexp(beta[e - n][word], through)
                        share = np.exp(alpha[e - n][word] + through - total[word])
                    for j in range(weights.shape[1]):
                        out[:, j] += np.bincount(ids, share * own[word, j], len(probs))
        return out


def prior(size: int) -> np.ndarray:
    """Piece probabilities before training: by rank in the vocabulary. The last is an unknown letter's."""
    p = 1 / (np.arange(size) + 50.0)
    return np.maximum(np.append(p / p.sum(), LEAST), LEAST)


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _stretches(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts in lower case in groups of about _SLICE letters, long ones cut between words, and whose they are."""
    own, parts, size = [], [], 0
    for i, text in enumerate(texts):
        whole = (text or b"").decode().lower()
        at = 0
        while at < len(whole):
            end = min(at + _SLICE, len(whole))
            while end < len(whole) and whole[end].isalpha():
                end += 1
            own.append(i)
            parts.append(whole[at:end])
            size += end - at
            at = end
            if size >= _SLICE:
                yield np.array(own), parts
                own, parts, size = [], [], 0
    if parts:
        yield np.array(own), parts


class _Words:
    """The words of stretches of text: hashes, where each begins in `whole`, its length, and each stretch's first word."""

    def __init__(self, parts: list[str]):
        self.whole = "\n".join([*parts, ""])
        codes = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        inner = _letters()[codes]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        self.start = np.flatnonzero(first)
        begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
        self.bounds = np.searchsorted(self.start, begins)
        at = np.flatnonzero(inner)
        head = np.flatnonzero(first[at])
        self.length = np.diff(np.append(head, len(at)))
        if not len(head):
            self.hash = np.zeros(0, np.uint64)
            return
        place = np.arange(len(at)) - np.repeat(head, self.length)
        turn = (place // len(ORDER)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        value = mix64((codes[at].astype(np.uint64) + np.uint64(1)) * ORDER[place % len(ORDER)] * turn)
        self.hash = mix64(np.add.reduceat(value, head) + self.length.astype(np.uint64))

    def text(self, i: int) -> str:
        return self.whole[self.start[i] : self.start[i] + self.length[i]]


def _hash_of(words: list[str]) -> np.ndarray:
    return _Words(words).hash


def _counted(hold: int = 150_000):
    """How often each word stands in the texts of each language: counts of a task's own texts, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, own in counts.items() for _ in own]
            arrays = [pa.array(langs, pa.string()), pa.array([w for own in counts.values() for w in own], pa.string())]
            arrays.append(pa.array([n for own in counts.values() for n in own.values()], pa.int64()))
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "n"])

        for part, texts in small_batches(batches, "text"):
            langs = part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = counts.setdefault(lang, Counter())
                for _, parts in _stretches([t for t, x in zip(texts, langs) if x == lang]):
                    words = _Words(parts)
                    _, at, n = np.unique(words.hash, return_index=True, return_counts=True)
                    for i, k in zip(at.tolist(), n.tolist()):
                        own[words.text(i)] += k
            if sum(map(len, counts.values())) > hold:
                yield flush()
        yield flush()

    return run


def _expected(vocab: list[str], block: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, probs = _lattice(vocab), prior(len(vocab))
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                total = sums.setdefault(lang, np.zeros(len(probs)))
                for i in range(0, len(own), block):
                    part = batch.take(pa.array(own[i : i + block]))
                    n = part.column("n").to_numpy().astype(float)
                    total += lattice.expected(part.column("word").to_pylist(), probs, n[:, None])[:, 0]
        for lang, total in sums.items():
            whole = np.rint(total * _UNIT).astype(np.int64)
            some = np.flatnonzero(whole)
            arrays = [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(whole[some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "piece", "n"])

    return run


_LATTICES: dict[tuple, Lattice] = {}


def _lattice(vocab: list[str]) -> Lattice:
    """One lattice for all tasks of a worker."""
    key = (len(vocab), hash(tuple(vocab)))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(vocab)
    return _LATTICES[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all of docs(text, lang) where both are given."""
    docs = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = docs.mapInArrow(_counted(), "lang string, word string, n bigint")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocab: list[str]) -> tuple[list[str], np.ndarray, DataFrame]:
    """Languages, probabilities[piece, language], and the word counts they come from, learnt from all of docs(text, lang).

    One step of expectation and maximisation from `prior`: words are counted first, so that each distinct word of a language
    is cut up once, however often it stands anywhere. What reaches the driver is a number for each piece and language.
    """
    counts = saved(word_counts(docs), "lang_words")
    sums = counts.mapInArrow(_expected(vocab), "lang string, piece bigint, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    langs = sorted(set(rows.column("lang").unique().to_pylist()))
    place = pc.index_in(rows.column("lang"), pa.array(langs, pa.string())).to_numpy()
    out = np.full((len(vocab) + 1, len(langs)), SMOOTHING)
    out[rows.column("piece").to_numpy(), place] += rows.column("n").to_numpy() / _UNIT
    out[-1] = SMOOTHING  # unknown letters tell nothing
    return langs, np.maximum(out / out.sum(axis=0), LEAST), counts


class _Scorer:
    """Scores of words in all languages; remembers what it has scored, up to a number of values."""

    def __init__(self, vocab: list[str], probs: np.ndarray, common: tuple[np.ndarray, np.ndarray]):
        self.lattice, self.probs = _lattice(vocab), probs
        self.first = self.keys, self.values = common

    def logs(self, words: _Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each of the distinct sorted `hashes`, whose words stand at places `at`."""
        out = np.empty((len(hashes), self.probs.shape[1]))
        place = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        known = self.keys[place] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        out[known] = self.values[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.lattice.forward([words.text(i) for i in at[new]], self.probs)
            if self.values.size + out[new].size > CACHE_VALUES:
                self.keys, self.values = self.first  # begin anew with the common words
            if self.values.size + out[new].size <= CACHE_VALUES:
                spot = np.searchsorted(self.keys, hashes[new])
                self.keys, self.values = np.insert(self.keys, spot, hashes[new]), np.insert(self.values, spot, out[new], axis=0)
        return out


_SCORERS: dict[str, _Scorer] = {}


def _predict(
    model: str, vocab: list[str], langs: list[str], probs: np.ndarray, common: tuple[np.ndarray, np.ndarray], columns: list[str], names: list[str]
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model] = _Scorer(vocab, probs, common)
        scorer = _SCORERS[model]
        for part, texts in small_batches(batches, "text"):
            logs, letters = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
            for own, parts in _stretches(texts) if langs else ():
                words = _Words(parts)
                if not len(words.hash):
                    continue
                hashes, at, place = np.unique(words.hash, return_index=True, return_inverse=True)
                each = scorer.logs(words, hashes, at)[place]
                n = np.diff(words.bounds)
                some = np.flatnonzero(n)
                np.add.at(logs, own[some], np.add.reduceat(each, words.bounds[some], axis=0))
                np.add.at(letters, own[some], n[some])
            best, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i in np.flatnonzero(letters):
                top = int(np.argmax(logs[i]))
                best[i], scores[i] = langs[top], 1 / np.exp(logs[i] - logs[i][top]).sum()
            arrays = [part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=columns + names)

    return run


def _scored(vocab: list[str], probs: np.ndarray, block: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                words = batch.column("word").slice(i, block).to_pylist()
                logs = _lattice(vocab).forward(words, probs)
                arrays = [pa.array(_hash_of(words).view(np.int64)), pa.array(list(logs), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["hash", "logs"])

    return run


def _common_scores(counts: DataFrame, vocab: list[str], probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and scores of the commonest training words, COMMON_WORDS and half of CACHE_VALUES at most."""
    most = min(COMMON_WORDS, CACHE_VALUES // (2 * max(1, probs.shape[1])))
    often = counts.where(F.length("word") <= PLAIN).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    found = often.select("word").mapInArrow(_scored(vocab, probs), "hash bigint, logs array<double>").toArrow().combine_chunks()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    logs = found.column("logs").combine_chunks().flatten().to_numpy().reshape(len(hashes), probs.shape[1])
    order = np.argsort(hashes)
    return hashes[order], logs[order]


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training. A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(
    docs: DataFrame, labelled: DataFrame, model_file: str, columns: Sequence[str] = ("doc_id",), names: Sequence[str] = ("lang_pred", "score")
) -> DataFrame:
    """`columns` of docs, and the language and score of docs(text) under `names`, learnt from labelled(text, lang).

    The score is the language's share of the likelihood of the whole text under all languages. Words are told by 64-bit
    hashes, and cut up as they stand, however long. A text that is null or has no letter is `und` with score 0, and so is every text if nothing is labelled; of equal scores the first language
    in the alphabet wins. Digits, marks and white space count for nothing. Each row is judged by its own text alone, so
    repeated rows are judged alike. Other columns are ignored; an empty table gives no rows.
    """
    vocab = vocabulary(model_file)
    langs, probs, counts = train(labelled, vocab)
    common = _common_scores(counts, vocab, probs)
    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = T.StructType([docs.schema[c] for c in columns]).add(names[0], "string").add(names[1], "double")
    return docs.mapInArrow(_predict(uuid.uuid4().hex, vocab, langs, probs, common, list(columns), list(names)), schema)
