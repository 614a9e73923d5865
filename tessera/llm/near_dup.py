"""Near-duplicate documents: bottom-k sketches, inverted lists, exact confirmation.

A document is the set of its distinct word shingles, as 64-bit hashes.  The
smallest hashes of a set are its bottom-k sketch: one hash function serves all
positions.  Documents with equal sets form a class; only classes are compared.

1. Inverted lists of the retained values that two or more classes share.  For
   linked classes nearly all of the smallest INDEXED values agree, so each
   class enters the lists of its rarest values only: as many as guarantee a
   meeting when MIN_SHARED values agree (prefix filtering, rarest first).
2. Lists with the same most central class are one group, so a class whose lists
   all hold the same copies is sent once, not once a list.  Groups are cut into
   parts of bounded size, each with a copy of the central class.
3. Inside a part, overlaps of retained values name the candidates, an estimate
   from the union of two 64-value sketches drops those clearly apart, and exact
   overlaps of the full sets, recomputed from the texts, confirm the rest.
   Only links that join two components of the part leave it: at most one a
   member, however many pairs are similar.
4. Groups of several parts that still hold several components (texts with a
   passage in common, mostly) are compared part by part if that sends few
   texts.  Otherwise they are indexed again, each for itself, by whole
   sketches: what the estimate asks of two sketches is so much that a class
   can leave out the half of its values that are most frequent in the group,
   the passage's among them.  Only what is then still in several parts and
   components is compared part by part.
5. Components of the links, in tables.

Values, centres and sets that very many rows share are joined by broadcast:
there are few of them, as each takes a fixed share of the rows.  Texts are
compared after a join with the members; a bit table of bounded size keeps most
of the others out of that exchange (past some millions of members it lets more
through, which costs shuffle and changes nothing).

Chance of missing a link at similarity 0.8: that fewer than MIN_SHARED of
INDEXED values agree is below 3e-7, that the estimate errs by more than SLACK
below 3e-8, and both less for nearer texts; for sets of at most INDEXED
shingles the lists are exact.

Defined cases: null, empty and blank texts have an empty set and no links;
a text shorter than a shingle is one shingle; rows with a null or repeated
identifier are separate rows; a component is named by its smallest non-null
identifier; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.components import components
from tessera.llm.textkit import Block, blocks, bounded_batches, map_batches, mix, text_of, window_hashes
from tessera.storage import materialise

SKETCH = 64
INDEXED = 16
MIN_SHARED = 4
#: Estimates of 64 values at similarity 0.8 lie 0.05 apart by one standard deviation; six of them are allowed.
SLACK = 0.30
#: A part of a group has about so many shingles and classes at most.
PART_SHINGLES, PART_CLASSES = 400_000, 2_000
#: A key is frequent from this many rows, and from this part of all rows.
FREQUENT_ROWS, FREQUENT_PART = 1_000, 1_000
#: Tables of at most so many narrow rows are broadcast whole.
SMALL = 200_000
#: Groups of several parts are compared part by part if that sends at most so many times the classes; else they are indexed again.
CROSS_COST = 4
#: Words of 64 bits in the table that keeps unwanted texts out of an exchange: one for every four keys, at most so many.
MOST_SLOTS = 1 << 20


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, ascending within a text, and the n+1 limits."""
    low = block.lowered()
    starts, ends, limits = low.spans()
    words = low.span_hashes(starts, ends)
    hashes, at = window_hashes(words, limits, size)
    owner = text_of(limits)[at]
    counts = np.diff(limits)
    for width in range(1, size):  # the whole sequence of a shorter text
        short = limits[:-1][counts == width]
        if len(short):
            whole = np.full(len(short), width, np.uint64)
            for j in range(width):
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + words[short + j])
            hashes = np.concatenate([hashes, whole])
            owner = np.concatenate([owner, np.flatnonzero(counts == width)])
    order = np.argsort(hashes)
    owner = owner[order].astype(np.uint16 if block.n < 1 << 16 else np.int64)
    back = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order][back], owner[back]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.n))])


def sketches(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, sketch) of each row; set_key is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, flat, ends = [], [], [], [0]
            for block in blocks(batch.column(2)):
                hashes, limits = shingle_sets(block, size)
                for a, b in zip(limits[:-1], limits[1:], strict=True):
                    counts.append(b - a)
                    keys.append(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    flat.append(hashes[a : min(b, a + SKETCH)])
                    ends.append(ends[-1] + len(flat[-1]))
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                ["doc_id", "text_key", "n_shingles", "set_key", "sketch"],
            )

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, text_key long, n_shingles long, set_key binary, sketch array<long>")


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: the smallest identifier with that row's text_key, the size and the sketch."""
    return (
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("text_key"), F.any_value("n_shingles").alias("n"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"))
    )


def _join_keyed(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Inner join with ``right``, a written table of one row a key, whose ``weight`` counts rows of ``left`` at least.

    Up to SMALL keys it is broadcast.  Of more, those of over 1 / FREQUENT_PART
    of ``rows`` rows are broadcast; as the weights sum up to a few times
    ``rows``, they are a few thousand at most.
    """
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), key)
    frequent = F.col(weight) > max(FREQUENT_ROWS, rows // FREQUENT_PART)
    hot = F.broadcast(right.where(frequent))
    rest = left.join(F.broadcast(right.where(frequent).select(key)), key, "left_anti").join(right.where(~frequent), key)
    return left.join(hot, key).unionByName(rest)


def _bits(slots: int) -> tuple[Column, Column]:
    """The word of a text key and its bits in that word."""
    bit = lambda at: f"shiftleft(1L, cast(shiftrightunsigned(text_key, {at}) & 63 as int))"
    return F.pmod("text_key", F.lit(slots)).cast("int"), F.expr(f"{bit(58)} | {bit(50)}")


def _sieve(wanted: DataFrame) -> tuple[DataFrame, int]:
    """(slot, mask): a bit table of the text keys of ``wanted``, of bounded size, and its number of words."""
    slots = min(MOST_SLOTS, max(1024, wanted.count() // 4))
    slot, bits = _bits(slots)
    return wanted.select(slot.alias("slot"), bits.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")), slots


def _sifted(rows: DataFrame, sieve: tuple[DataFrame, int], how: str = "left_semi") -> DataFrame:
    """The rows whose text_key may be in the bit table, or with ``left_anti`` those whose text_key is not in it."""
    table, slots = sieve
    slot, bits = _bits(slots)
    return rows.join(F.broadcast(table), (slot == table["slot"]) & (table["mask"].bitwiseAND(bits) == bits), how)


def _postings(index: DataFrame, needed: Column, width: int, rows: int) -> DataFrame:
    """(value, owner, set_key, n, weight): the lists that hold two or more classes, each class in those of its rarest values.

    ``index`` is (value, owner, set_key, n), with at most ``width`` values for
    each (owner, set_key), of which linked classes share ``needed``.
    """
    shared = materialise(index.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1"), "values")
    own = Window.partitionBy("owner", "set_key")
    retained = F.least("n", F.lit(width))
    place = retained - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "value"))
    return (
        _join_keyed(index, shared, "value", "holders", rows)
        .withColumns({"place": place, "weight": F.sum("holders").over(own)})
        .where(F.col("place") <= retained - needed + 1)
        .select("value", "owner", "set_key", "n", "weight")
    )


def _groups(postings: DataFrame, rows: int) -> DataFrame:
    """(centre, set_key, n): the members of all lists with the same most central class, that class among them."""
    hubs = materialise(postings.groupBy("value").agg(F.max(F.struct("weight", "set_key")).alias("hub"), F.count("*").alias("held")), "hubs")
    return _join_keyed(postings, hubs, "value", "held", rows).select(F.col("hub.set_key").alias("centre"), "set_key", "n").distinct()


class _Inverted:
    """For the values of some sets the members that hold them, as flat arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.limits = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[order][1:] != flat[order][:-1]
        self.owners = np.repeat(np.arange(len(sets)), np.diff(self.limits))[order]
        self.starts = np.append(np.flatnonzero(new), len(flat))
        self.value = np.empty(len(flat), np.int64)
        self.value[order] = np.cumsum(new) - 1
        self.members = len(sets)

    def overlaps(self, i: int) -> np.ndarray:
        """How many values member ``i`` shares with each member."""
        own = self.value[self.limits[i] : self.limits[i + 1]]
        first, length = self.starts[own], self.starts[own + 1] - self.starts[own]
        shared = length > 1
        first, length = first[shared], length[shared]
        if not len(first):
            return np.zeros(self.members, np.int64)
        at = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
        return np.bincount(self.owners[at], minlength=self.members)


def links_within(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that join different labels; only pairs across sides, if there are sides.

    ``label`` numbers the components known so far and is changed.
    """
    sizes = np.array([len(s) for s in sets])
    padded = np.full((len(sets), SKETCH), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i, values in enumerate(sets):
        padded[i, : min(len(values), SKETCH)] = values[:SKETCH]
    kept = np.minimum(sizes, SKETCH)
    # up to this value a sketch knows its set
    reach = np.where(sizes > SKETCH, padded[:, -1], np.uint64(0xFFFFFFFFFFFFFFFF))
    sketched, full, found = _Inverted([s[:SKETCH] for s in sets]), None, []
    for i in range(1, len(sets)):
        common = sketched.overlaps(i)[:i]
        hope = (common > 0) & (label[:i] != label[i]) & (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i]))
        if side is not None:
            hope &= side[:i] != side[i]
        near = np.flatnonzero(hope)
        if not len(near):
            continue
        bound = np.minimum(reach[near], reach[i])
        mine = np.searchsorted(padded[i, : kept[i]], bound, side="right")
        theirs = np.minimum((padded[near] <= bound[:, None]).sum(axis=1), kept[near])
        near = near[common[near] >= (percent / 100 - SLACK) * (mine + theirs - common[near])]
        if not len(near):
            continue
        full = full or _Inverted(sets)
        both = full.overlaps(i)[near]
        for j in near[100 * both >= percent * (sizes[near] + sizes[i] - both)]:
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def _links(units: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(u, v): the links inside units (centre, i, j, side, set_key, root) by full sets recomputed from the texts."""
    wanted = materialise(units.join(classes.select("set_key", "doc_id", "text_key"), "set_key"), "wanted")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    source = _sifted(source, _sieve(wanted))
    rows = source.join(wanted, (source["text_key"] == wanted["text_key"]) & source["doc_id"].eqNullSafe(wanted["doc_id"])).select("centre", "i", "j", "side", "set_key", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(members: dict[bytes, tuple[int, bytes, np.ndarray]]) -> Iterator[tuple[bytes, bytes]]:
            keys = sorted(members)
            roots = np.unique([members[k][1] for k in keys], return_inverse=True)[1]
            side = np.array([members[k][0] for k in keys])
            for a, b in links_within([members[k][2] for k in keys], roots, None if (side == side[0]).all() else side, percent):
                yield keys[a], keys[b]

        unit, members = None, {}
        for batch in batches:
            row, found = 0, []
            fields = [batch.column(i).to_pylist() for i in range(6)]
            for block in blocks(batch.column(6)):
                hashes, limits = shingle_sets(block, size)
                for a, b in zip(limits[:-1], limits[1:], strict=True):
                    here = fields[0][row], fields[1][row], fields[2][row]
                    if here != unit:
                        if len(members) > 1:
                            found.extend(compare(members))
                        unit, members = here, {}
                    members[fields[4][row]] = (fields[3][row], fields[5][row], hashes[a:b].copy())
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["u", "v"])
        found = list(compare(members)) if len(members) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["u", "v"])

    return map_batches(rows.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j"), run, "u binary, v binary")


def _parted(groups: DataFrame, rows: int) -> DataFrame:
    """Members with their group's number of parts and their own part."""
    groups = materialise(groups, "members")
    sizes = groups.groupBy("centre").agg(F.greatest(F.ceil(F.sum("n") / PART_SHINGLES), F.ceil(F.count("*") / PART_CLASSES)).cast("int").alias("parts"), F.count("*").alias("members"))
    sizes = materialise(sizes.where("members > 1"), "sizes")
    return _join_keyed(groups, sizes, "centre", "members", rows).withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))


def _inner_units(parted: DataFrame) -> DataFrame:
    """A unit for each part; the centre is in all of them."""
    everywhere = F.when(F.col("set_key") == F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    return parted.withColumn("i", F.explode(everywhere)).select("centre", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "set_key", "root")


def _rooted(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``members`` with the root of their component; a component's own root is not in ``joined``."""
    return members.drop("root").join(joined.select(F.col("node").alias("set_key"), "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))


def _unsettled(parted: DataFrame, joined: DataFrame, rows: int) -> DataFrame:
    """The members of the groups of several parts that still hold several components."""
    placed = _rooted(parted.where("parts > 1"), joined)
    several = placed.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")).where("low <> high").select("centre", "held")
    return _join_keyed(placed, materialise(several, "several"), "centre", "held", rows).drop("held")


def _cross_units(unsettled: DataFrame) -> DataFrame:
    """A unit for each two parts of a group."""
    spread = unsettled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    return spread.select("centre", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("part").alias("side"), "set_key", "root")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, represents) for each row of ``docs``.

    Rows are linked when 100 * intersection >= ``percent`` * union of their
    sets of ``size``-word shingles; component_id is the smallest identifier
    that links reach, and kept tells the row that bears it.
    """
    signed = materialise(sketches(docs, size, doc_id, text), "sketches")
    classes = materialise(_classes(signed), "classes")
    known = classes.count()
    links = lambda units: _links(units, classes, docs, size, percent, doc_id, text)
    edges = lambda found: found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    index = classes.select(F.explode(F.slice("sketch", 1, INDEXED)).alias("value"), F.lit(0).alias("owner"), "set_key", "n")
    postings = materialise(_postings(index, F.least(F.ceil(F.col("n") * percent / 100), F.lit(MIN_SHARED)), INDEXED, known), "postings")
    parted = _parted(_groups(postings, known), known).withColumn("root", F.col("set_key"))
    joined = components(links(_inner_units(parted)))
    left = materialise(_unsettled(parted, joined, known), "unsettled")
    cost = left.agg(F.coalesce(F.sum(F.col("parts") - 1), F.lit(0))).head()[0]
    if cost > CROSS_COST * known:
        whole = left.select("centre", "set_key").join(classes.select("set_key", "n", "sketch"), "set_key").select("centre", "set_key", "n", F.explode("sketch").alias("v"))
        index = whole.select(F.xxhash64("centre", "v").alias("value"), F.col("centre").alias("owner"), "set_key", "n")
        needed = F.greatest(F.ceil((percent / 100 - SLACK) * F.least("n", F.lit(SKETCH))), F.lit(1))
        postings = materialise(_postings(index, needed, SKETCH, known), "postings")
        parted = materialise(_rooted(_parted(_groups(postings, known), known), joined), "groups")
        joined = components(edges(joined).unionAll(links(_inner_units(parted))))
        left = materialise(_unsettled(parted, joined, known), "unsettled")
        cost = left.count()
    if cost:
        joined = components(edges(joined).unionAll(links(_cross_units(left))))
    # the representative of each component: its smallest identifier, nulls last
    least = joined.unionAll(joined.select(F.col("root").alias("node"), "root").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    own = classes.select("set_key", "copies", order.alias("own"))
    named = least.join(own.select(F.col("set_key").alias("node"), "own"), "node")
    names = named.groupBy("root").agg(F.min("own").alias("chosen"))
    by_class = named.join(names, "root").select(F.col("node").alias("set_key"), "chosen")
    # a class of one row without links stands for itself
    chosen = own.join(by_class, "set_key", "left").where("copies > 1 or chosen is not null")
    chosen = materialise(chosen.select("set_key", "copies", F.coalesce("chosen", "own").alias("chosen")), "chosen")
    narrow, few = signed.drop("sketch"), chosen.select("set_key", "chosen")
    out = narrow.where("set_key is null").withColumn("chosen", F.lit(None).cast(chosen.schema["chosen"].dataType))
    narrow = narrow.where("set_key is not null")
    if chosen.count() <= SMALL:
        out = out.unionByName(narrow.join(F.broadcast(few), "set_key", "left"))
    else:
        frequent = F.col("copies") > max(FREQUENT_ROWS, known // FREQUENT_PART)
        hot = F.broadcast(chosen.where(frequent).drop("copies"))
        rest = narrow.join(F.broadcast(chosen.where(frequent).select("set_key")), "set_key", "left_anti")
        out = out.unionByName(narrow.join(hot, "set_key")).unionByName(rest.join(chosen.where(~frequent).drop("copies"), "set_key", "left"))
    out = out.withColumn("component_id", F.coalesce("chosen.doc_id", "doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    single = F.col("chosen").isNull() | (same & (F.col("text_key") == F.col("chosen.text_key")))
    return out.select("doc_id", "n_shingles", "component_id", same.alias("kept"), "text_key", single.alias("represents"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group; rows with an empty set all stay.

    Copies of a row with the same identifier are one group too.
    """
    found = materialise(near_duplicates(docs, size, percent, doc_id, text), "groups")
    here = docs.columns
    key, gone_id, gone_key = (f"__{name}_{uuid.uuid4().hex}" for name in ("key", "gone_id", "gone_key"))  # no column of docs is called so
    losing = found.where(~F.col("represents")).select("doc_id", "text_key").distinct()
    gone = losing.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    sieve = _sieve(losing)
    packed = docs.select(F.xxhash64(text).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in here]).alias("row"))
    passing = lambda how: _sifted(packed, sieve, how).select("row.*", F.col("text_key").alias(key))
    left = passing("left_semi").join(gone, (F.col(key) == F.col(gone_key)) & F.col(doc_id).cast("long").eqNullSafe(F.col(gone_id)), "left_anti").unionAll(passing("left_anti"))
    repeated = found.where("represents and n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if not repeated.isEmpty():
        words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
        left = left.where(words).dropDuplicates([doc_id, key]).unionAll(left.where(~F.coalesce(words, F.lit(False))))
    return left.select(*here)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles at similarity 0.8 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=4).select("doc_id", "n_shingles", "component_id", "kept")
