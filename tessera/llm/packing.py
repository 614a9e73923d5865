"""Packing documents into sequences: a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` ids; full pieces are
sequences by themselves.  The rest is dealt by hash into shards of bounded
size.  A solution of a shard is a grouping of its pieces into bins.  Crossover
injects whole well-filled bins of one parent into the other, dissolves the
bins that hold the same pieces twice, and puts the displaced pieces back by
best fit; mutation dissolves the emptiest bins and some others.  Several
islands evolve each shard in separate tasks from different starts; between
epochs each island's elite migrates to the next.  The first solution of a shard
is best fit by falling length; where that already meets the lower bound of the
total length it is proven best, and the shard takes no part in the evolution
(so it is with many short documents).

All state between epochs is in tables of the shared folder, one row an island
(the lengths and a few groupings of one shard, so of bounded size).  Random
numbers are seeded by shard, island and epoch: a repeated task repeats itself.

Defined cases: a null or empty text is the single closing id; repeated rows
are packed separately; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.textkit import Block, blocks, bounded_batches, kept, map_batches, mix
from tessera.storage import materialise

CAPACITY = 2048
SHARD = 16_384
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 2, 2, 20, 6, 1
#: Times that badly filled sequences of all shards are dealt anew, at most.
ROUNDS = 4
#: A bin counts as well filled from this share of the capacity.
WELL_FILLED = 0.995
#: Units whose ids a task keeps at most; when full, those seen in one block only go.
CACHED = 1_000_000
#: Units encoded as one text.
TOGETHER = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


_U = np.uint64
SPACE, LETTER, MARK, DIGIT, OTHER = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x21:0x7F] = MARK
    for low, high in (("a", "z"), ("A", "Z")):
        kinds[ord(low) : ord(high) + 1] = LETTER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[ord("'")] = OTHER
    kinds[[0x20, 9, 10, 11, 12, 13]] = SPACE
    kinds[0xC3] = LETTER  # with the byte behind it, looked at below
    return kinds


_KIND = _kinds()
_OTHER_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64) * _U(0x9FB21C651E98DF25))


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and whole-word flags of a block's units, the n+1 limits, and the bytes that name them.

    A unit is what the tokenizer takes by itself: a run of letters, a run of
    marks, a digit; lower-cased.  Words with anything but ASCII and Latin-1
    letters, or with an apostrophe, are one unit each, as written.
    """
    data = block.data
    kind = _KIND[data]
    low = block.lowered().data
    if len(data) and data.max() >= 0x80:
        before = np.concatenate([[0], data[:-1]])
        inner = (data & 0xC0) == 0x80
        latin = inner & (before == 0xC3) & (data != 0x97) & (data != 0xB7)
        kind[inner] = OTHER
        kind[latin] = LETTER
        low[latin & (data < 0x9F)] += 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[block.bounds] = True
    word = kind != SPACE
    previous = np.concatenate([np.zeros(1, np.uint8), kind[:-1]]) if len(kind) else kind
    starts = word & ((kind != previous) | (kind == DIGIT) | edge[:-1])
    whole = np.zeros(len(data), bool)
    if (kind == OTHER).any():
        first, last, _ = block.spans()
        running = np.concatenate([[0], np.cumsum(kind == OTHER)])
        odd = running[last] > running[first]
        first, last = first[odd], last[odd]
        length = last - first
        inside = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
        starts[inside] = False
        starts[first] = whole[first] = True
        low[inside] = data[inside]
    ends = word & np.concatenate([starts[1:] | ~word[1:], [True]]) if len(data) else word
    if len(data):
        ends |= word & edge[1:]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, whole[starts], np.searchsorted(starts, block.bounds), low


class WordEncoder:
    """Ids of whole texts, encoding each distinct unit (see :func:`units`) once.

    The ids of a text are those of its units in order.  Units are known by a
    96-bit hash in an open table; their ids lie in one flat array.  Texts that
    hold the tokenizer's special strings are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.is_special = np.zeros(len(self.ends_word), bool)
        self.is_special[self.tokenizer.token_to_id(self.special[0])] = True
        self.side = 1 << max(4, (2 * CACHED).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(self.side, -1, np.int32)
        self.count, self.filled = 0, 0
        self.key, self.check = np.empty(1024, np.uint64), np.empty(1024, np.uint32)
        self.start, self.length, self.often = np.empty(1024, np.int64), np.empty(1024, np.int32), np.zeros(1024, bool)
        self.ids = np.empty(4096, np.uint32)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each unit, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        at = (key & _U(self.side - 1)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            entry = self.slot[at[left]]
            left, entry = left[entry >= 0], entry[entry >= 0]
            same = (self.key[entry] == key[left]) & (self.check[entry] == check[left])
            out[left[same]] = entry[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (self.side - 1)
        return out

    def _place(self, entries: np.ndarray) -> None:
        at = (self.key[entries] & _U(self.side - 1)).astype(np.int64)
        while len(entries):
            free = self.slot[at] < 0
            self.slot[at[free]] = entries[free]
            lost = self.slot[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & (self.side - 1)

    def _add(self, key: np.ndarray, check: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New entries; the caller has seen that there is room."""
        entries = np.arange(self.count, self.count + len(key))
        self.count += len(key)
        for name in ("key", "check", "start", "length", "often"):
            old = getattr(self, name)
            if len(old) < self.count:
                setattr(self, name, np.concatenate([old, np.zeros(max(self.count, 2 * len(old)) - len(old), old.dtype)]))
        if len(self.ids) < self.filled + len(ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(ids), len(self.ids)), np.uint32)])
        self.key[entries], self.check[entries], self.length[entries], self.often[entries] = key, check, lengths, False
        self.start[entries] = self.filled + np.cumsum(lengths) - lengths
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self._place(entries)
        return entries

    def _make_room(self) -> None:
        """Leaves the entries that more than one block asked for, if they are not too many."""
        keep = np.flatnonzero(self.often[: self.count])
        key, check, lengths = self.key[keep], self.check[keep], self.length[keep]
        ids = self.ids[_ranges(self.start[keep], lengths)]
        self._clear()
        if len(keep) <= CACHED // 2:
            self._add(key, check, lengths, ids)

    def _encoded(self, texts: list[str], separator: str, is_end: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of many units, encoded some hundred to a text; ``inside`` is 1 if the id that ends a unit belongs to it, else 0."""
        lengths, found = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        parts = [separator.join(texts[low : low + TOGETHER]) + separator for low in range(0, len(texts), TOGETHER)]
        for encoded in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            ids = np.array(encoded.ids, np.uint32)
            end = is_end[ids]
            lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(end)])) + inside - 1)
            found.append(ids if inside else ids[~end])
        return np.concatenate(lengths), np.concatenate(found)

    def _learn(self, key: np.ndarray, check: np.ndarray, whole: np.ndarray, texts: list[str]) -> np.ndarray:
        """Entries of new units."""
        out = np.empty(len(key), np.int64)
        for flag, separator, is_end, inside in ((False, " ", self.ends_word, 1), (True, self.special[0], self.is_special, 0)):
            these = np.flatnonzero(whole == flag)
            lengths, ids = self._encoded([texts[i] for i in these.tolist()], separator, is_end, inside)
            out[these] = self._add(key[these], check[these], lengths, ids)
        return out

    def _block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts and their n+1 limits."""
        starts, ends, whole, limits, low = units(block)
        named = Block(block.first, low, block.bounds)
        key = named.span_hashes(starts, ends) + whole.astype(np.uint64)
        check = (named.span_hashes(starts, ends, _OTHER_BYTE) >> _U(32)).astype(np.uint32)
        entry = self._find(key, check)
        new = np.flatnonzero(entry < 0)
        _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
        if self.count + len(first) > CACHED:
            self._make_room()
            entry = self._find(key, check)
            new = np.flatnonzero(entry < 0)
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            if 2 * (self.count + len(first)) > self.side:  # a text of very many distinct units
                self.side = 1 << (4 * (self.count + len(first))).bit_length()
                self.slot = np.full(self.side, -1, np.int32)
                self._place(np.arange(self.count))
        self.often[entry[entry >= 0]] = True
        if len(new):
            at = new[first]
            body = low.tobytes()
            texts = [body[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            entry[new] = self._learn(key[at], check[at], whole[at], texts)[back]
        lengths = self.length[entry].astype(np.int64)
        return self.ids[_ranges(self.start[entry], lengths)], np.concatenate([[0], np.cumsum(lengths)])[limits]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: empty) as unsigned 32-bit numbers."""
        texts = texts.fill_null("")
        odd = pc.match_substring(texts, self.special[0])
        for special in self.special[1:]:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        out: list[np.ndarray] = []
        for block in blocks(pc.if_else(odd, "", texts)):
            ids, limits = self._block(block)
            out += [ids[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document's ids with the closing id 0: only longer documents are cut."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("words", path), lambda: WordEncoder(path))
        for batch in batches:
            rows = []
            for key, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids = found.astype("<u4").tobytes() + b"\0\0\0\0"
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, number, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, PIECES, keeps=True)


def best_fit(order: np.ndarray, sizes: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Puts the items in ``order`` into the fullest bins that hold them, opening new ones; changes ``bins`` and ``free``."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, room in enumerate(free):
        if room > 0:
            by_room[room].append(b)
            rooms |= 1 << room
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            left = room - size
            free[b] = left
        else:
            b, left = len(free), capacity - size
            free.append(left)
        bins[item] = b
        if left:
            by_room[left].append(b)
            rooms |= 1 << left


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _fills(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes).astype(np.int64)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how unevenly (the better) they are filled."""
    fills = _fills(bins, sizes)
    return len(fills), -float(((fills / capacity) ** 2).sum())


def _refill(bins: np.ndarray, displaced: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit of the displaced items, longest first, into the bins of the others."""
    out = np.full(len(sizes), -1, np.int32)
    stay = ~displaced
    out[stay] = _compact(bins[stay]) if stay.any() else 0
    free = (capacity - _fills(out[stay], sizes[stay])).tolist() if stay.any() else []
    items = np.flatnonzero(displaced)
    noise = rng.integers(0, max(2, capacity // 128), len(items))
    best_fit(items[np.argsort(-(sizes[items] + noise), kind="stable")], sizes, out, free, capacity)
    return out


def crossover(giver: np.ndarray, taker: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``giver`` enter ``taker``; taker's bins that hold the same items dissolve."""
    fills = _fills(giver, sizes)
    chosen = (fills >= WELL_FILLED * capacity) & (rng.random(len(fills)) < 0.5)
    injected = chosen[giver]
    touched = np.zeros(int(taker.max()) + 1, bool)
    touched[taker[injected]] = True
    displaced = touched[taker] & ~injected
    merged = np.where(injected, giver + len(touched), taker)
    return _refill(merged, displaced, sizes, capacity, rng)


def mutate(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and as many others dissolve."""
    fills = _fills(bins, sizes)
    few = max(2, len(fills) // 50)
    gone = np.zeros(len(fills), bool)
    gone[np.argsort(fills)[:few]] = True
    gone[rng.integers(0, len(fills), few)] = True
    return _refill(bins, gone[bins], sizes, capacity, rng)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: tuple[int, ...], generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first."""
    rng = np.random.default_rng(seed)
    bound = math.ceil(sizes.sum() / capacity)
    rank = lambda p: fitness(p, sizes, capacity)
    while len(population) < (POPULATION if generations else 1):
        spread = 0 if not population else capacity // 16
        order = np.argsort(-(sizes + rng.integers(0, spread + 1, len(sizes))), kind="stable")
        bins: np.ndarray = np.full(len(sizes), -1, np.int32)
        best_fit(order, sizes, bins, [], capacity)
        population.append(bins)
        if rank(bins)[0] <= bound:
            break
    population.sort(key=rank)
    for _ in range(generations):
        if rank(population[0])[0] <= bound or len(population) < 2:
            break
        children = []
        for _ in range(POPULATION // 2):
            a, b = rng.choice(len(population), 2, replace=False)
            child = crossover(population[min(a, b)], population[max(a, b)], sizes, capacity, rng)
            children.append(mutate(child, sizes, capacity, rng))
        population = sorted(population + children, key=rank)[:POPULATION]
    return population


def _islands(state: DataFrame, capacity: int, epoch: int, generations: int = GENERATIONS) -> DataFrame:
    """Each island's population after some generations; after none, the best fit of the shard alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, island, lengths, groupings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = np.array(lengths, np.int64)
                found = evolve(sizes, [np.frombuffer(g, np.int32).copy() for g in groupings], capacity, (shard, epoch, island), generations)
                out.append((shard, island, lengths, [f.astype(np.int32).tobytes() for f in found], fitness(found[0], sizes, capacity)[0]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "island", "lengths", "groupings", "bins"])

    chosen = state.select("shard", "island", "lengths", "groupings")
    return map_batches(chosen, run, "shard long, island int, lengths array<int>, groupings array<binary>, bins int")


def _packed(small: DataFrame, level: int, shards: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """``small`` dealt into shards and packed, with sequence_id, offset and the length of the whole sequence as ``fill``."""
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(level)), F.lit(shards)))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("minus"), "doc_id", "piece", "start", "ids_crc32")))
    grouped = materialise(dealt.repartition(shards, "shard").groupBy("shard").agg(rows.alias("rows")), "shards")
    start = grouped.select("shard", F.lit(0).alias("island"), F.transform("rows", lambda r: (-r["minus"]).cast("int")).alias("lengths"), F.expr("cast(array() as array<binary>)").alias("groupings"))
    first = materialise(_islands(start, capacity, 0, 0), "islands")
    bound = F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) / capacity)
    best = first.select("shard", "bins", "island", F.get("groupings", F.lit(0)).alias("grouping"))
    state = first.where(F.col("bins") > bound).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    hard = state.count()
    for epoch in range(epochs if hard else 0):
        state = materialise(_islands(state.repartition(hard, "shard", "island"), capacity, epoch), "islands")
        if epoch < epochs - 1:  # the elite of each island joins the next one's population
            guests = state.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.slice("groupings", 1, ELITE).alias("guests"))
            state = state.join(guests, ["shard", "island"]).withColumn("groupings", F.concat("guests", "groupings"))
    if hard:
        best = best.unionAll(state.select("shard", "bins", "island", F.get("groupings", F.lit(0))))
    best = best.groupBy("shard").agg(F.min_by("grouping", F.struct("bins", "island")).alias("grouping"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, members, grouping in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bins = np.frombuffer(grouping, np.int32)
                sizes = np.array([-m["minus"] for m in members], np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(bins[order], bins[order], side="left")
                offsets = np.empty(len(bins), np.int64)
                offsets[order] = before - before[first]
                columns = [[m[c] for m in members] for c in ("doc_id", "piece", "start")]
                number = (level << 60) + (shard << 24) + bins.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(sizes), pa.array([m["ids_crc32"] for m in members], pa.int64()), pa.array(number), pa.array(offsets), pa.array(_fills(bins, sizes)[bins])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"],
                )

    return materialise(map_batches(grouped.join(best, "shard").select("shard", "rows", "grouping"), place, PLACED + ", fill long"), "packed")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``items`` (PIECES columns) with sequence_id (any numbers) and offset.

    After each round the sequences that are not well filled dissolve, and what
    they held from all shards is dealt anew into fewer shards, as long as that
    saves sequences.
    """
    names = [part.split()[0] for part in PLACED.split(", ")]
    full = items.where(F.col("length") >= capacity).select(*names[:5], (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, rest, loose, sequences = [full], items.where(F.col("length") < capacity).select(*names[:5]), None, 0
    for level in range(ROUNDS):
        shards = max(1, math.ceil(rest.count() / shard_size))
        placed = _packed(rest, level, shards, capacity, islands, epochs)
        if loose is not None and placed.select("sequence_id").distinct().count() >= sequences:
            placed, shards = loose, 1  # nothing is gained: the sequences before stay
        if shards == 1:
            loose = placed
            break
        parts.append(placed.where(F.col("fill") >= WELL_FILLED * capacity))
        loose = placed.where(F.col("fill") < WELL_FILLED * capacity)
        sequences = loose.select("sequence_id").distinct().count()
        rest = loose.select(*names[:5])
    parts.append(loose)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part.select(*names))
    return out


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(materialise(pieces(docs), "pieces"))
