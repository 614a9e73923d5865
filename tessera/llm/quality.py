"""Quality rules by distribution divergence.

A document is described by two histograms: its code points by character class
and its words by common word (everything else in one bucket).  A language
reference is the mean of the normalised histograms of all distinct texts of
that language that pass the base rules, so copies have no weight; the mean over
the distinct texts of all languages takes part like a few texts more.  A
language has a reference if it has MIN_TEXTS distinct texts and 1 / MOST_LANGUAGES
of all texts, so there are at most MOST_LANGUAGES, whatever the column holds.
A document is judged by the Jensen-Shannon distances to the reference of its
own language; where that has none, or the document is far from it (its language
may be given wrongly), by those to the nearest reference of all.  Texts under a minimum length
carry too little evidence for a histogram and are left to the base rules.

Defined cases: a null or empty text has no words, zero counts and fails the
base rules; a null language is one like others; without any reference the base rules decide;
repeated rows and ties are judged row by row; an empty table gives an empty
result; extra columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import blocks, bounded_batches, map_batches, mix, text_of, window_hashes
from tessera.storage import materialise

#: The most frequent function words of the four languages.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on with as are be this by from or an at not have has which but his her they we",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque",
}
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Texts of a language that the mean over all languages stands for.
PRIOR_TEXTS = 3
#: Distinct texts that make a reference, and the most references there are.
MIN_TEXTS, MOST_LANGUAGES = 8, 1024
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document: a limit for long
#: texts, and an allowance over the square root of the word count for the noise of short ones.
MAX_CLASS_DISTANCE = (0.11, 1.0)
MAX_WORD_DISTANCE = (0.22, 2.0)

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "classes array<int>, common array<int>"
)
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "punctuation", "symbol", "control", "two", "three", "four")


def _class_table() -> np.ndarray:
    table = np.full(256, -1, np.int8)  # continuation bytes belong to no class
    table[0:0x80] = CLASSES.index("control")
    table[0x21:0x7F] = CLASSES.index("punctuation")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[[0x20, 9]] = CLASSES.index("space")
    table[[10, 13]] = CLASSES.index("newline")
    table[[ord(c) for c in ".,"]] = CLASSES.index("stop")
    table[[ord(c) for c in SYMBOLS[1:-1]]] = CLASSES.index("symbol")
    table[0xC0:0xE0] = CLASSES.index("two")
    table[0xE0:0xF0] = CLASSES.index("three")
    table[0xF0:] = CLASSES.index("four")
    return table


_CLASS = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS[1:-1]])
_IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_TRAILING = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])


def common_words() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words in order, and the number of the word each belongs to."""
    hashes = []
    for block in blocks(pa.array([w.lower() for w in common_words()])):
        starts, ends, _ = block.spans()
        hashes.append(block.span_hashes(starts, ends))
    joined = np.concatenate(hashes)
    order = np.argsort(joined)
    return joined[order], order


def _positions_of_repeats(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Flags of the items whose hash occurs twice or more in their text."""
    keyed = mix(hashes + texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order[1:]] == keyed[order[:-1]]
    flags = np.zeros(len(keyed), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _later_equals(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Flags of the items equal to an earlier one of their text."""
    keyed = mix(hashes + texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    flags = np.zeros(len(keyed), bool)
    flags[order[1:][keyed[order[1:]] == keyed[order[:-1]]]] = True
    return flags


def measure(texts: pa.Array) -> list[np.ndarray]:
    """For each text its five counts, its class histogram and its common-word histogram."""
    known, number = _common_hashes()
    width, depth = len(known) + 1, len(CLASSES)
    found: list[list[np.ndarray]] = []
    for block in blocks(texts):
        n, data = block.n, block.data
        starts, ends, limits = block.spans()
        words = np.diff(limits)
        word_text = text_of(limits)
        hashes = block.span_hashes(starts, ends)
        # words in 3-word windows that occur twice or more
        windows, at = window_hashes(hashes, limits, 3)
        repeated = at[_positions_of_repeats(windows, word_text[at])]
        covered = np.zeros(len(starts) + 3, np.int64)
        for j in range(3):
            covered[repeated + j] = 1
        running = np.concatenate([[0], np.cumsum(covered[: len(starts)])])
        repeats = running[limits[1:]] - running[limits[:-1]]
        # lines with a word that equal an earlier line
        breaks = np.flatnonzero(data == 10)
        inner = block.bounds[1:-1]
        line_starts = np.unique(np.concatenate([[0], breaks + 1, inner])) if len(data) else np.empty(0, np.int64)
        line_starts = line_starts[line_starts < len(data)].astype(np.int64)
        line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
        if len(line_starts):
            line_ends = line_ends - (data[line_ends - 1] == 10)
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[has_word], line_ends[has_word]
        line_text = np.searchsorted(block.bounds, line_starts, side="right") - 1
        later = _later_equals(block.span_hashes(line_starts, line_ends), line_text)
        dup_lines = np.bincount(line_text[later], minlength=n)
        # histograms
        classes = np.stack([block.per_text(_CLASS[data] == k) for k in range(depth)], axis=1)
        low = block.lowered()
        trimmed = ends - _TRAILING[data[ends - 1]] if len(ends) else ends
        keys = low.span_hashes(starts, trimmed)
        slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        slot = np.where(known[slot] == keys, number[slot], width - 1)
        common = np.bincount(word_text * width + slot, minlength=n * width).reshape(n, width)
        found.append(
            [words, block.per_text(~_IS_SPACE[data] & _STARTS_CODE_POINT[data]), block.per_text(_IS_SYMBOL[data]), dup_lines, repeats, classes, common]
        )
    return [np.concatenate(part) for part in zip(*found, strict=True)]


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).astype(np.int32)))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of each document with its counts and histograms."""
    names = [part.split()[0] for part in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = measure(batch.column(len(keep)))
            arrays = [pa.array(p.astype(np.int64)) for p in parts[:5]] + [_lists(p) for p in parts[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + arrays, keep + names)

    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{schema}, {FEATURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(measured: DataFrame, lang: str = "lang", copy: str = "__copy") -> dict[str, dict[str, list[float]]]:
    """For each language with enough texts the mean normalised histograms over all its distinct texts that pass the base rules.

    Rows with the same ``copy`` are one text.  At most MOST_LANGUAGES vectors
    reach the driver, whatever the number of documents and languages.
    """
    shapes = (("classes", len(CLASSES)), ("common", len(common_words()) + 1))
    passing = measured.where(~base_failed()).select(F.col(copy).alias("copy"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), "classes", "common")
    texts = passing.groupBy("copy", "lang").agg(F.any_value("classes").alias("classes"), F.any_value("common").alias("common"))
    counts = materialise(texts.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    least = max(MIN_TEXTS, -(-(counts.agg(F.sum("n")).head()[0] or 0) // MOST_LANGUAGES))
    large = F.broadcast(counts.where(F.col("n") >= least).select("lang"))

    def means(frame: DataFrame, *by: str) -> list:
        sums = []
        for name, size in shapes:
            frame = frame.withColumn(f"n_{name}", F.aggregate(name, F.lit(0), lambda a, x: a + x))
            sums += [F.avg(F.col(name)[i] / F.col(f"n_{name}")).alias(f"{name}_{i}") for i in range(size)]
        return frame.groupBy(*by).agg(F.count("*").alias("n"), *sums).collect()

    rows = means(texts.join(large, "lang"), "lang")
    overall = means(passing.groupBy("copy").agg(F.any_value("classes").alias("classes"), F.any_value("common").alias("common")))[0]
    mixed = lambda row, c: (row["n"] * (row[c] or 0.0) + PRIOR_TEXTS * (overall[c] or 0.0)) / (row["n"] + PRIOR_TEXTS)
    return {row["lang"]: {name: [mixed(row, f"{name}_{i}") for i in range(size)] for name, size in shapes} for row in rows}


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts to one distribution; rows of zeros are at distance 1."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1e-300), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    out = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return np.where(total[:, 0] > 0, out, 1.0)


def _far(words: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Which rows are over the limits for their length."""
    root = np.sqrt(np.maximum(words, 1))
    over = [distances[:, k] > limit + noise / root for k, (limit, noise) in enumerate((MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE))]
    return over[0] | over[1]


def judge(measured: DataFrame, refs: dict[str, dict[str, list[float]]], lang: str = "lang") -> DataFrame:
    """Adds class_distance and word_distance to the reference that counts, base_failed and kept."""
    names = sorted(refs)
    models = [(np.array(refs[n]["classes"]), np.array(refs[n]["common"])) for n in names]
    number = {n: k for k, n in enumerate(names)}
    columns = measured.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            grids = [batch.column(columns.index(c)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("classes", "common")]
            words = batch.column(columns.index("n_words")).to_numpy()
            own = np.array([number.get(str(x or ""), -1) for x in batch.column(columns.index(lang)).to_pylist()])
            best = np.full((n, 2), np.inf if models else 0.0)

            def distances(k: int, rows: np.ndarray, grids: list[np.ndarray] = grids) -> np.ndarray:
                return np.stack([divergence(g[rows], r) for g, r in zip(grids, models[k], strict=True)], axis=1)

            for k in np.unique(own[own >= 0]).tolist():
                rows = np.flatnonzero(own == k)
                best[rows] = distances(k, rows)
            rest = np.flatnonzero(_far(words, best)) if models else np.empty(0, int)
            for k in range(len(models)):
                found = distances(k, rest)
                nearer = found.sum(axis=1) < best[rest].sum(axis=1)
                best[rest[nearer]] = found[nearer]
            odd = (words >= MIN_WORDS) & _far(words, best)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best[:, 0]), pa.array(best[:, 1]), pa.array(odd)], [*columns, "class_distance", "word_distance", "__odd"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields)
    far = map_batches(measured, run, f"{schema}, class_distance double, word_distance double, __odd boolean")
    return far.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("__odd")).drop("__odd")


def quality(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Each document's ``keep`` columns, counts, distances and verdict.

    The texts are read once: counts and histograms go to the shared folder, and
    both the references and the verdicts come from that narrow table.
    """
    columns = list(dict.fromkeys([*keep, lang]))
    marked = docs.withColumn("__copy", F.xxhash64(F.col(text).cast("string")))
    measured = materialise(features(marked, [*columns, "__copy"], text), "quality")
    return judge(measured, references(measured, lang), lang).drop("__copy")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and distribution verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )
