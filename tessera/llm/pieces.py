"""Encoding into pieces of a SentencePiece vocabulary, with the N best segmentations, and decoding.

A text's lattice has an edge for each piece wherever its characters stand; a
segmentation is a path, and its score the sum of its pieces' scores.  Forward
Viterbi scores give, for every position, the best score of any path to it from
the start.  Searched from the end backwards they are exact heuristics: A-star
pops paths in the order of their total scores, so the first N that reach the
start are the N best.

No piece holds a space mark behind another character, nor a line end, so the
lattice falls into independent words, and equal words have equal lattices.  The
N best of a text are its words' best, and the combinations of the few words
whose second-best path costs least: a text's path that leaves the best one at
any other word is beaten by N others.  Forward and backward Viterbi run for
many new words at once; A-star runs only for words that a result needs.

Spaces become marks and a mark is put in front, as the vocabulary's models do;
characters without a piece become their UTF-8 bytes' pieces.  Of paths with
equal scores, those that end in longer pieces come first.

Defined cases: null and empty texts have one segmentation, the empty one, of
score 0; repeated rows are encoded separately; an empty table gives an empty
result; extra columns are not read.  Whole texts are encoded.  Decoding gives
the text back, but for marks in the text itself, which become spaces.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import bounded_batches, kept, map_batches, mix

MARK = "▁"
BEST = 3
#: New words after which a task starts a new generation of those it keeps; it keeps two.
CACHED = 300_000
#: Words whose lattices are built at once.
TOGETHER = 4000
#: Words of more characters are followed edge by edge, not beside others.
LONG = 200
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces with their scores, and what a word needs to be segmented."""

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.scores = np.array([model.get_score(i) for i in range(len(self.pieces))])
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.longest = max(map(len, self.ids))
        # a character without a piece costs more than any path of pieces through ordinary ones
        self.unknown = min(s for s in self.scores[list(self.ids.values())] if s > -1e8) - 10
        # characters that stand in no piece with others end words
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\r\t" if c not in joined)
        # sums of whole numbers are exact: equal scores are equal whatever the order of their sums
        self.exact = bool((self.scores == np.round(self.scores)).all())
        self._tables()

    def _tables(self) -> None:
        """For each length the hashes of the pieces' beginnings, ascending, and the numbers of those that are pieces (others: -1)."""
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen: list[np.ndarray] = []  # by a hash's upper bits, whether any beginning has them
        self.firsts: list[tuple[np.ndarray, int]] = []  # by these bits the first beginning with them, and how many have them at most
        by_length: list[dict[str, int]] = [{} for _ in range(self.longest)]
        for piece, number in self.ids.items():
            for length in range(1, len(piece)):
                by_length[length - 1].setdefault(piece[:length], -1)
            by_length[len(piece) - 1][piece] = number
        for length, found in enumerate(by_length, 1):
            points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(found), length)
            hashes = np.zeros(len(found), np.uint64)
            for k in range(length):
                hashes = mix(hashes * _BASE + points[:, k])
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array(list(found.values()), np.int64)[order]))
            share = np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
            self.seen.append(share > 0)
            self.firsts.append(((np.cumsum(share) - share).astype(np.int32), int(share.max())))

    def find(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are beginnings of pieces, and the numbers of those."""
        keys, numbers = self.tables[length - 1]
        first, most = self.firsts[length - 1]
        upper = (hashes >> np.uint64(48)).astype(np.int64)
        maybe = np.flatnonzero(self.seen[length - 1][upper])
        mine, at = hashes[maybe], first[upper[maybe]]
        for _ in range(most - 1):
            at = np.minimum(at + (keys[at] < mine), len(keys) - 1)
        same = np.flatnonzero(keys[at] == mine)
        return maybe[same], numbers[at[same]]

    def words(self, text: str) -> list[str]:
        """The independent words: marks with what follows them up to the next mark or line end, marks by themselves, line ends."""
        if not text:
            return []
        parted = MARK + text.replace(MARK, " ").replace(" ", f" {MARK}")
        for c in self.alone:
            parted = parted.replace(c, f" {c} ")
        while f"{MARK} {MARK}" in parted:
            parted = parted.replace(f"{MARK} {MARK}", MARK + MARK)
        return list(filter(None, parted.split(" ")))

    def spell(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in character.encode("utf-8", "surrogatepass"))


class Lattices:
    """Edges of many words at once, by the position they end at and there from the longest down.

    Positions are numbered place by place over all words, the longest words
    first, so that one step takes a slice; a long word's stand side by side.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary = vocabulary
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._number_positions()
        word = np.repeat(np.arange(len(words)), self.sizes)
        place = np.arange(len(points)) - self.starts[word]
        left = self.sizes[word] - place
        most = min(vocabulary.longest, int(self.sizes.max(initial=1)))
        table = np.zeros((len(self.place), most), np.int32)  # by end and length: 0 no edge, 1 a character without a piece, else the piece and 2
        alive, hashes = np.arange(len(points)), np.zeros(len(points), np.uint64)
        table[self.position(word, place + 1), most - 1] = 1
        for length in range(1, most + 1):
            hashes = mix(hashes * _BASE + points[alive + (length - 1)])
            begun, number = vocabulary.find(hashes, length)
            alive, hashes = alive[begun], hashes[begun]
            whole = np.flatnonzero(number >= 0)
            found = alive[whole]
            table[self.position(word[found], place[found] + length), most - length] = number[whole] + 2
            further = np.flatnonzero(left[alive] > length)
            alive, hashes = alive[further], hashes[further]
        filled = np.flatnonzero(table)
        self.end, column = np.divmod(filled, most)
        self.length = most - column
        self.number = table.ravel()[filled] - 2
        self.score = np.where(self.number >= 0, vocabulary.scores[self.number], vocabulary.unknown)
        self.begin = self.position(self.word[self.end], self.place[self.end] - self.length)
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(self.end, minlength=len(self.place)))])  # each position's edges
        self._viterbi()

    def _number_positions(self) -> None:
        """``word`` and ``place`` of each position; a word has one more than characters."""
        order = np.argsort(-self.sizes, kind="stable")
        ranked = self.sizes[order]
        self.long = int((ranked > LONG).sum())
        aside = ranked[: self.long] + 1
        self.bases = np.cumsum(aside) - aside
        live = np.searchsorted(-ranked[self.long :], -np.arange(int(ranked[self.long :].max(initial=0)) + 1), side="right")
        self.offsets = int(aside.sum()) + np.concatenate([[0], np.cumsum(live)])
        place = np.repeat(np.arange(len(live)), live)
        beside = np.arange(len(place)) + self.offsets[0] - self.offsets[place] + self.long
        self.word = np.concatenate([np.repeat(order[: self.long], aside), order[beside]])
        self.place = np.concatenate([np.arange(int(aside.sum())) - np.repeat(self.bases, aside), place])
        self.shift = np.empty(len(order), np.int64)
        self.shift[order] = np.concatenate([self.bases, np.arange(len(order) - self.long)])

    def position(self, words: np.ndarray | int, places: np.ndarray) -> np.ndarray:
        if not self.long:
            return self.offsets[places] + self.shift[words]
        return np.where(self.sizes[words] > LONG, places, self.offsets[np.minimum(places, len(self.offsets) - 1)]) + self.shift[words]

    def _viterbi(self) -> None:
        """Best scores to each position from the start (``forward``) and from it to the end, and each word's second-best cost."""
        count = len(self.place)
        self.forward = np.where(self.place == 0, 0.0, -np.inf)
        backward = np.where(self.place == self.sizes[self.word], 0.0, -np.inf)
        for base, size in zip(self.bases.tolist(), self.sizes[self.word[self.bases]].tolist(), strict=True):
            self._follow(base, base + size, backward)
        offsets, edges = self.offsets.tolist(), self.cuts[self.offsets].tolist()
        for p in range(1, len(offsets) - 1):
            low, high, here = edges[p], edges[p + 1], slice(offsets[p], offsets[p + 1])
            self.forward[here] = np.maximum.reduceat(self.forward[self.begin[low:high]] + self.score[low:high], self.cuts[here] - low)
        for p in range(len(offsets) - 2, 0, -1):  # edges to one place begin at different positions
            low, high = edges[p], edges[p + 1]
            begin = self.begin[low:high]
            backward[begin] = np.maximum(backward[begin], backward[self.end[low:high]] + self.score[low:high])
        to = self.forward[self.begin] + self.score
        last = self.position(np.arange(len(self.sizes)), self.sizes)
        self.best = self.forward[last]
        # each position's best edge, of equals the longest
        equal = np.flatnonzero(to == self.forward[self.end])
        back = np.zeros(count, np.int64)
        back[self.end[equal][::-1]] = equal[::-1]
        off_path = np.ones(len(self.end), bool)
        while len(last):
            step = back[last]
            off_path[step] = False
            last = self.begin[step]
            last = last[self.place[last] > 0]
        # the best paths' pieces in the order of the characters where they begin
        path = np.flatnonzero(~off_path)
        begin = self.begin[path]
        pieces = np.zeros(int(self.sizes.sum()), np.int32)
        pieces[self.starts[self.word[begin]] + self.place[begin]] = self.number[path] + 2
        self.path_chars = np.flatnonzero(pieces)
        self.path_numbers = pieces[self.path_chars] - 2
        second = np.full(len(self.sizes), -np.inf)
        others = np.flatnonzero(off_path)
        np.maximum.at(second, self.word[self.end[others]], to[others] + backward[self.end[others]])
        self.gap = self.best - second

    def _follow(self, first: int, last: int, backward: np.ndarray) -> None:
        """Both directions of one long word, by its edges in order."""
        edges = slice(int(self.cuts[first]), int(self.cuts[last + 1]))
        begins, ends, scores = (self.begin[edges] - first).tolist(), (self.end[edges] - first).tolist(), self.score[edges].tolist()
        ahead, behind = self.forward[first : last + 1].tolist(), backward[first : last + 1].tolist()
        for a, b, value in zip(begins, ends, scores, strict=True):
            if ahead[a] + value > ahead[b]:
                ahead[b] = ahead[a] + value
        for a, b, value in zip(reversed(begins), reversed(ends), reversed(scores), strict=True):
            if behind[b] + value > behind[a]:
                behind[a] = behind[b] + value
        self.forward[first : last + 1] = ahead
        backward[first : last + 1] = behind

    def best_ids(self, texts: list[str]) -> list[bytes]:
        """The best path of each word, as little-endian 32-bit numbers."""
        limits = np.searchsorted(self.path_chars, np.append(self.starts, self.sizes.sum()))
        data, cuts = self.path_numbers.astype("<u4").tobytes(), (limits * 4).tolist()
        out = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        spelled = np.unique(np.searchsorted(limits, np.flatnonzero(self.path_numbers < 0), side="right") - 1)
        for w in spelled.tolist():
            here = slice(limits[w], limits[w + 1])
            out[w] = np.array(self.ids_of(texts[w], self.path_numbers[here].tolist(), (self.path_chars[here] - self.starts[w]).tolist()), "<u4").tobytes()
        return out

    def ids_of(self, text: str, numbers: list[int], places: list[int]) -> tuple[int, ...]:
        """Pieces' numbers, and the bytes of characters without a piece."""
        out: list[int] = []
        for number, at in zip(numbers, places, strict=True):
            out.extend((number,) if number >= 0 else self.vocabulary.spell(text[at]))
        return tuple(out)

    def nbest(self, word: int, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to ``n`` paths of one word, (score, ids), by A-star from its end."""
        size = int(self.sizes[word])
        positions = self.position(word, np.arange(size + 1))
        forward = self.forward[positions].tolist()
        low, high = self.cuts[positions].tolist(), self.cuts[positions + 1].tolist()
        tick = itertools.count()
        agenda = [(-forward[size], size, next(tick), 0.0, ())]
        found = []
        while agenda and len(found) < n:
            _, at, _, done, path = heapq.heappop(agenda)
            if at == 0:
                numbers, places = [], []
                while path:  # (first number, its place, the rest)
                    numbers.append(path[0])
                    places.append(path[1])
                    path = path[2]
                found.append((done, self.ids_of(text, numbers, places)))
                continue
            edges = slice(low[at], high[at])
            for length, score, number in zip(self.length[edges].tolist(), self.score[edges].tolist(), self.number[edges].tolist(), strict=True):
                heapq.heappush(agenda, (-(forward[at - length] + score + done), at - length, next(tick), score + done, (number, at - length, path)))
        return found


class Words(dict):
    """Words by number, in the order they come; ``new`` are those without a solution yet."""

    def __init__(self):
        self.new: list[str] = []
        self.ids: list[bytes] = []
        self.scores, self.gaps, self.sizes = np.empty(0), np.empty(0), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def solve(self, ids: list[bytes], scores: np.ndarray, gaps: np.ndarray) -> None:
        self.ids += ids
        self.scores, self.gaps = np.concatenate([self.scores, scores]), np.concatenate([self.gaps, gaps])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.new = []


class Encoder:
    """Segmentations of whole texts; each distinct word is solved once while it is kept."""

    def __init__(self, vocabulary: Vocabulary, n: int = BEST):
        self.vocabulary, self.n = vocabulary, n
        self.young, self.old = Words(), Words()
        self.several: dict[str, list[tuple[float, bytes]]] = {}

    def _pack(self, ids: tuple[int, ...]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def learn(self) -> None:
        """Best path, its score and the cost of the second best of all new words."""
        new = self.young.new
        known = np.array([self.old.get(w, -1) for w in new], np.int64)
        ids: list[bytes] = [self.old.ids[k] if k >= 0 else b"" for k in known.tolist()]
        scores, gaps = np.zeros(len(new)), np.zeros(len(new))
        scores[known >= 0], gaps[known >= 0] = self.old.scores[known[known >= 0]], self.old.gaps[known[known >= 0]]
        unknown = np.flatnonzero(known < 0)
        for low in range(0, len(unknown), TOGETHER):
            places = unknown[low : low + TOGETHER]
            part = [new[k] for k in places.tolist()]
            lattices = Lattices(self.vocabulary, part)
            best = lattices.best_ids(part)
            if not self.vocabulary.exact:
                for k in np.flatnonzero(lattices.gap == 0).tolist():  # which of equals is first is the search's to say
                    best[k] = self._pack(lattices.nbest(k, part[k], 1)[0][1])
            for k, found in zip(places.tolist(), best, strict=True):
                ids[k] = found
            scores[places], gaps[places] = lattices.best, lattices.gap
        self.young.solve(ids, scores, gaps)

    def find_alternatives(self, words: set[str]) -> None:
        """The paths of words after their best, as (cost, ids)."""
        if len(self.several) > CACHED:
            self.several = {}
        new = list(words.difference(self.several))
        for low in range(0, len(new), TOGETHER):
            part = new[low : low + TOGETHER]
            lattices = Lattices(self.vocabulary, part)
            for k, word in enumerate(part):
                paths = lattices.nbest(k, word, self.n)
                self.several[word] = [(paths[0][0] - score, self._pack(ids)) for score, ids in paths[1:]]

    def _cheapest(self, gaps: np.ndarray) -> list[int]:
        """The places of the few smallest finite costs, ascending, of equals the first."""
        few = self.n - 1
        places = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1]) if 0 < few < len(gaps) else np.arange(len(gaps))
        places = places[np.argsort(gaps[places], kind="stable")][:few]
        return places[gaps[places] < np.inf].tolist()

    def encode(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        """For each text its N best segmentations, (score, ids as little-endian 32-bit numbers)."""
        split = [self.vocabulary.words(t) for t in texts]
        limits = [0, *itertools.accumulate(map(len, split))]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, Words()
        numbers = np.fromiter(map(self.young.__getitem__, itertools.chain.from_iterable(split)), np.int64, limits[-1])
        self.learn()
        spans = list(itertools.pairwise(limits))
        chosen = [self._cheapest(self.young.gaps[numbers[a:b]]) for a, b in spans]
        self.find_alternatives({words[place] for words, places in zip(split, chosen, strict=True) for place in places})
        for words, (a, b), places in zip(split, spans, chosen, strict=True):
            mine = numbers[a:b]
            best = b"".join(map(self.young.ids.__getitem__, mine.tolist()))
            score, ends = float(sum(self.young.scores[mine].tolist())), np.cumsum(self.young.sizes[mine])
            out = [(score, best)]
            options = [[(0.0, (), None), *((cost, (place, rank), ids) for rank, (cost, ids) in enumerate(self.several[words[place]]))] for place in places]
            ways = sorted((sum(o[0] for o in way), [o[1] for o in way if o[1]], [o[2] for o in way]) for way in itertools.product(*options))
            for cost, _, ids in ways[1 : self.n]:
                parts, at = [], 0
                for place, option in sorted((place, option) for option, place in zip(ids, places, strict=True) if option is not None):
                    end = int(ends[place])
                    parts += (best[at : end - int(self.young.sizes[mine[place]])], option)
                    at = end
                out.append((score - cost, b"".join((*parts, best[at:]))))
            yield out


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of pieces; bytes that are no UTF-8 become replacement characters."""
    spelled = {n: b for b, n in vocabulary.byte.items()}
    data = b"".join(bytes([spelled[i]]) if i in spelled else vocabulary.pieces[i].encode("utf-8", "surrogatepass") for i in ids)
    return data.decode("utf-8", "replace").replace(MARK, " ")[1:]


def segment(docs: DataFrame, n: int = BEST, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids) of the ``n`` best segmentations of every whole text; ids as an array of integers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("pieces", path, n), lambda: Encoder(Vocabulary(path), n))
        for batch in batches:
            keys, ranks, scores, parts, ends = [], [], [], [], [0]
            for key, found in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                for rank, (score, ids) in enumerate(found, 1):
                    keys.append(key)
                    ranks.append(rank)
                    scores.append(score)
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                ["doc_id", "rank", "score", "n_pieces", "ids"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, rank int, score double, n_pieces long, ids array<int>", keeps=True)


def decoded(segments: DataFrame, path: str | None = None) -> DataFrame:
    """``segments`` (doc_id, rank, ids) with the texts they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            texts = [decode(vocabulary, ids) for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "rank", "text"])

    return map_batches(segments.select("doc_id", "rank", "ids"), run, "doc_id long, rank int, text string")


def op6_segmentations(spark, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document: score, number of pieces, and a checksum of the ids and of the text they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("pieces", None, BEST), lambda: Encoder(Vocabulary()))
        speller = Speller(encoder.vocabulary)
        for batch in batches:
            rows = []
            for key, found in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                rows += [(key, rank, score, len(ids) // 4, zlib.crc32(ids), zlib.crc32(speller.text(ids))) for rank, (score, ids) in enumerate(found, 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "text_crc32"])

    return map_batches(docs, run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, text_crc32 long", keeps=True)


class Speller:
    """Decoded bytes of packed ids, all at once."""

    def __init__(self, vocabulary: Vocabulary):
        spelled = {n: b for b, n in vocabulary.byte.items()}
        parts = [bytes([spelled[i]]) if i in spelled else p.encode("utf-8", "surrogatepass").replace(MARK.encode(), b" ") for i, p in enumerate(vocabulary.pieces)]
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def text(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of a segmentation's text, without the mark in front."""
        numbers = np.frombuffer(ids, "<u4")
        sizes = self.sizes[numbers]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.data[at].tobytes()[1:]
