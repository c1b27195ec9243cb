"""N-best segmentation of whole texts into pieces of a public vocabulary, and decoding.

The lattice of a text has an edge for every piece that fits at a place. Forward Viterbi scores of all places are exact
heuristics for a search from the end back to the start, so paths leave the search in the order of their scores. The
lattice falls apart at places that no piece of the vocabulary spans; parts that repeat are solved once.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces as small_batches
from .lang_id import MARK, Lattice

BEST = 4
#: Parts whose segmentations a worker remembers.
CACHE_PARTS = 300_000
#: Places of a block of lattices that are solved together.
BLOCK_PLACES = 2_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class Vocabulary:
    """Pieces, their ids and scores. Scores are the model's if it has log probabilities; a vocabulary of merges has only
    ranks, and a piece's probability is then taken to fall with its rank."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.ids = [i for i in range(size) if not special[i]]
        self.pieces = [sp.id_to_piece(i) for i in self.ids]
        ranked = model.trainer_spec.model_type != proto.TrainerSpec.UNIGRAM
        self.scores = [-math.log(n + 2) if ranked else sp.get_score(i) for n, i in enumerate(self.ids)]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_score = min(self.scores) - 1
        self.unknown_id = sp.unk_id()
        inner = {p[i - 1 : i + 1] for p in self.pieces for i in range(1, len(p))}
        if any(b[1] == MARK and b[0] != MARK or "\n" in b for b in inner):
            raise ValueError("the vocabulary has pieces across words")
        letters = re.compile(f"[{_LETTERS}]")
        marks = "".join(m for m in string.punctuation if not any(b[1] == m and letters.match(b[0]) for b in inner))
        ahead = f"[{re.escape(marks)}{MARK}\n]" if marks else f"[{MARK}\n]"
        self.parts = re.compile(rf"{MARK}*[{_LETTERS}]+(?={ahead}|\Z)|{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def spelt(self, letter: str) -> list[int]:
        """The ids of a letter without a piece: those of its bytes."""
        own = [self.bytes.get(b) for b in letter.encode()]
        return own if None not in own else [self.unknown_id]

    def letter_score(self, letter: str) -> float:
        return self.byte_score * len(letter.encode())


def decode(ids: Iterator[int], table: dict[int, bytes]) -> bytes:
    """The text of ids; table has each id's bytes."""
    text = b"".join([table[i] for i in ids]).replace(MARK.encode(), b" ")
    return text[1:] if text[:1] == b" " else text


def byte_table(vocab: Vocabulary) -> dict[int, bytes]:
    table = {i: p.encode() for i, p in zip(vocab.ids, vocab.pieces)}
    table |= {i: bytes([b]) for b, i in vocab.bytes.items()}
    return table | {vocab.unknown_id: "⁇".encode()}


def best_paths(part: str, n: int, vocab: Vocabulary, known: dict[str, int], longest: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a part, as (score, ids), by A-star search from the end."""
    size = len(part)
    edges: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    forward = [-math.inf] * (size + 1)
    forward[0] = 0.0
    for end in range(1, size + 1):
        for start in range(max(0, end - longest), end):
            i = known.get(part[start:end])
            if i is not None:
                edges[end].append((start, i, vocab.scores[i]))
            elif start == end - 1:
                edges[end].append((start, -1, vocab.letter_score(part[start])))
        forward[end] = max(forward[s] + w for s, _, w in edges[end])
    out: list[tuple[float, list[int]]] = []
    order = itertools.count()
    heap: list = [(-forward[size], next(order), size, 0.0, None)]
    while heap and len(out) < n:
        _, _, at, behind, path = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path is not None:
                (start, i), path = path
                ids += vocab.spelt(part[start]) if i < 0 else [vocab.ids[i]]
            out.append((behind, ids))
            continue
        for start, i, weight in edges[at]:
            score = behind + weight
            heapq.heappush(heap, (-(forward[start] + score), next(order), start, score, ((start, i), path)))
    return out


class Solver:
    """Remembers of each part its best ids, score and number of pieces, and how far its second best path is behind."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.lattice = Lattice(vocab.pieces, mark="")
        self.longest = max(map(len, vocab.pieces))
        self.known = {p: i for i, p in enumerate(vocab.pieces)}
        self.scores = np.array([*vocab.scores, 0.0])
        self.place: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.score = np.zeros(1 << 12)
        self.behind = np.zeros(1 << 12)
        self.paths: dict[str, list[tuple[float, bytes]]] = {}

    def _solve(self, parts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        order, lengths, found = self.lattice.edges(parts)
        size, n = int(lengths.max()) + 1, len(parts)
        best = np.full((size, n), -np.inf)
        best[0] = 0
        back = np.zeros((size, n), np.int32)
        back_id = np.zeros((size, n), np.int32)
        unknown = self.lattice.unknown

        def weights(e: int, word: np.ndarray, ids: np.ndarray) -> np.ndarray:
            w = self.scores[ids]
            strange = np.flatnonzero(ids == unknown)
            if len(strange):
                w[strange] = [self.vocab.letter_score(parts[order[word[i]]][e - 1]) for i in strange]
            return w

        weighed = [[(k, word, ids, weights(e, word, ids)) for k, word, ids in own] for e, own in enumerate(found)]
        for e in range(1, size):
            for k, word, ids, w in weighed[e]:
                total = best[e - k][word] + w
                better = total > best[e][word]
                won = word[better]
                best[e][won], back[e][won], back_id[e][won] = total[better], k, ids[better]
        behind = np.full(n, np.inf)
        at = lengths.copy()  # where the best path of each part has got to, from its end
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for e in range(size - 1, 0, -1):
            here = at == e
            for k, word, ids, w in weighed[e]:
                side = here[word] & ~((back[e][word] == k) & (back_id[e][word] == ids))
                if side.any():
                    word = word[side]
                    np.minimum.at(behind, word, best[e][word] - best[e - k][word] - w[side])
            word = np.flatnonzero(here)
            steps.append((word, np.full(len(word), e), back_id[e][word]))
            at[word] -= back[e][word]
        word, end, ids = (np.concatenate(x) for x in zip(*steps))
        by_word = np.lexsort((end, word))
        word, end, ids = word[by_word], end[by_word], ids[by_word]
        real = np.array([*self.vocab.ids, -1], np.int64)[ids]
        cuts = np.searchsorted(word, np.arange(n + 1))
        out: list[bytes] = [b""] * n
        raw = real.astype("<u4").tobytes()
        strange = set(word[real < 0].tolist())
        for i in range(n):
            a, b = cuts[i], cuts[i + 1]
            if i in strange:
                text = parts[order[i]]
                own = [x for j in range(a, b) for x in ([int(real[j])] if real[j] >= 0 else self.vocab.spelt(text[end[j] - 1]))]
                out[order[i]] = np.array(own, "<u4").tobytes()
            else:
                out[order[i]] = raw[4 * a : 4 * b]
        score, gap = np.empty(n), np.empty(n)
        score[order], gap[order] = best[lengths, np.arange(n)], behind
        return out, score, gap

    def places(self, parts: list[str]) -> np.ndarray:
        """Where the parts are remembered; new ones are solved together."""
        found = list(map(self.place.get, parts))
        if None in found:
            if len(self.ids) > CACHE_PARTS:
                self.place.clear()
                self.ids.clear()
            if len(self.paths) > CACHE_PARTS:
                self.paths.clear()
            new = sorted({p for p in parts if p not in self.place}, key=len)
            block: list[str] = []
            for p in [*new, None]:
                if block and (p is None or (len(p) + 1) * (len(block) + 1) > BLOCK_PLACES or len(block) >= 20_000):
                    ids, score, behind = self._solve(block)
                    first = len(self.ids)
                    while first + len(block) > len(self.score):
                        self.score, self.behind = (np.concatenate([x, np.zeros(len(x))]) for x in (self.score, self.behind))
                    self.score[first : first + len(block)], self.behind[first : first + len(block)] = score, behind
                    self.ids += ids
                    self.place.update(zip(block, range(first, first + len(block))))
                    block = []
                if p is not None:
                    block.append(p)
            found = list(map(self.place.get, parts))
        return np.array(found, np.int64)

    def alternatives(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths of a part: (how far behind the best, ids)."""
        if part not in self.paths:
            found = best_paths(part, n, self.vocab, self.known, self.longest)
            self.paths[part] = [(found[0][0] - s, np.array(ids, "<u4").tobytes()) for s, ids in found]
        return self.paths[part]


def segmentations(parts: list[str], n: int, solver: Solver, places: np.ndarray | None = None) -> tuple[list[float], list[bytes]]:
    """Scores and ids of the n best segmentations of a text given as parts, best first.

    A path that leaves the best one in some part is at least as far behind as that part's second best path. So n best
    paths leave it only in the n - 1 parts whose second best paths are least behind, and those are searched.
    """
    if not parts:
        return [0.0], [b""]
    places = solver.places(parts) if places is None else places
    own = [solver.ids[i] for i in places.tolist()]
    top = float(solver.score[places].sum())
    behind = solver.behind[places]
    few = np.argsort(behind, kind="stable")[: n - 1] if len(behind) <= 64 else _least(behind, n - 1)
    few = [int(i) for i in few if np.isfinite(behind[i])]
    options = [solver.alternatives(parts[i], n) for i in few]
    paths = heapq.nsmallest(n, itertools.product(*[range(len(o)) for o in options]), key=lambda c: (sum(o[i][0] for o, i in zip(options, c)), c))
    scores, ids = [], []
    for choice in paths:
        path = own.copy()
        for i, option, c in zip(few, options, choice):
            path[i] = option[c][1]  # also the first: of equally good paths it needn't be the one remembered
        scores.append(top - sum(o[c][0] for o, c in zip(options, choice)))
        ids.append(b"".join(path))
    return scores, ids


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values; of equal ones the first."""
    if n < 1:
        return np.zeros(0, int)
    limit = np.partition(values, n - 1)[n - 1]
    low = np.flatnonzero(values <= limit)
    return low[np.argsort(values[low], kind="stable")][:n]


def parts_of(text: str, vocab: Vocabulary) -> list[str]:
    """The whole text as parts that no piece spans; spaces are marks, and one stands before the text."""
    return vocab.parts.findall(MARK + text.replace(" ", MARK)) if text else []


@functools.cache
def _tools(model_file: str) -> tuple[Vocabulary, Solver, dict[int, bytes]]:
    """Made once in a worker, for all of its tasks."""
    vocab = Vocabulary(model_file)
    return vocab, Solver(vocab), byte_table(vocab)


def _segment(model_file: str, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, solver, table = _tools(model_file)
        for part, texts in small_batches(batches, "text"):
            found = [parts_of(t.decode(), vocab) if t else [] for t in texts]
            places = solver.places([p for own in found for p in own])
            ends = np.cumsum([len(own) for own in found])
            rows = []
            for text, own, end in zip(texts, found, ends):
                scores, ids = segmentations(own, n, solver, places[end - len(own) : end])
                whole = decode(np.frombuffer(ids[0], "<u4").tolist(), table) == (text or b"")
                rows.append((len(own), whole, scores, [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], ids))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            names = ["n_parts", "decodes", "scores", "n_pieces", "ids_crc32", "ids"]
            last = len(names) if with_ids else -1
            arrays = [pa.array(c, k) for c, k in zip(columns[:last] if last < 0 else columns, kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *names[: len(arrays)]])

    return run


def n_best(docs: DataFrame, model_file: str, n: int = BEST, with_ids: bool = False) -> DataFrame:
    """doc_id, n_parts, decodes, scores, n_pieces and ids_crc32 of the n best segmentations of each row's whole text.

    Best first; fewer than n where the text has fewer. `decodes` says whether the best one's ids give the text back,
    which they do unless the text itself holds the vocabulary's word mark. ids_crc32 are checksums of the ids as
    little-endian unsigned 32-bit numbers; with_ids adds these. Letters without a piece are spelt in bytes. A null or
    empty text has one segmentation, without pieces. Each row is a text of its own, repeated ids and texts, too; a null
    doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id bigint, n_parts bigint, decodes boolean, scores array<double>, n_pieces array<int>, ids_crc32 array<bigint>"
    schema += ", ids array<binary>" if with_ids else ""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_segment(model_file, n, with_ids), schema)


def _decode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tools(model_file)[2]
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [None if x is None else decode(np.frombuffer(x, "<u4").tolist(), table) for x in ids]
            texts = [None if t is None else t.decode(errors="replace") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text for rows(doc_id, ids), ids as little-endian unsigned 32-bit numbers in binary; null ids, null text."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(model_file), "doc_id bigint, text string")
