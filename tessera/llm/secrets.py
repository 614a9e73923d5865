"""Secret scans with DataFrame expressions only.

Base kinds (leftmost, non-overlapping per kind, failing matches consumed):
``assign``, ``access`` and ``hex``.  The method adds ``random``: tokens whose
character transitions are likelier under a Markov model of random strings than
under one of ordinary identifiers, by log-likelihood ratio per transition, and
that overlap no base span.  Both models are counted from labelled samples:
from documents, the values of base spans are random and all other tokens
ordinary; digests and joined word parts are generated beside them, so that
collections without secrets or without identifiers have both.

Bounds: about SAMPLED_ROWS documents with an identifier are sampled (by hash,
so the same ones each time), and each distinct token of theirs counts once.

Java's regular expressions give the matches and the gaps between them; running
sums of both lengths are the positions, taken in blocks so that a text with
very many matches costs no quadratic copying.

Defined cases: a null or empty text has no spans; repeated rows are treated row
by row; an empty table gives an empty result; extra columns are kept as they
are (the operator's own are named by the caller).  Whole texts are scanned.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Patterns; the shortest length of what counts is checked on the match (assign: on its value).
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}+",
    "random": r"[A-Za-z0-9+/_=-]{20,}+",
}
#: What stands before an assignment's value.
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
MIN_VALUE, MIN_ACCESS = 6, 20
#: Mean log2 likelihood ratio per transition from which a token counts as random.
MIN_RATIO = 0.75
MASK = "[secret]"
_BLOCK = 256
_SIDE = 128

#: Documents that the models are counted from, about.
SAMPLED_ROWS = 2_000
#: Shortest token that is learnt from.
MIN_TOKEN = 8

#: Parts of ordinary identifiers for the built-in sample.
PARTS = (
    "get set make read write open close load save find list user name file path data table index value count total first last next "
    "item node tree key map queue stack buffer stream string number config option default handler manager factory service client server "
    "request response message event error result status update delete create insert select from where group order account image page "
    "https www example com org net html content description version license project document section language international"
).split()


def generated_sample(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """A generated sample (token, is_random) of ``rows`` of each kind: digests in three alphabets, and joined word parts."""
    ids = spark.range(rows)
    digest = F.sha2(F.col("id").cast("string"), 512)
    random = F.when(F.col("id") % 3 == 0, F.substring(F.translate(F.base64(F.unhex(digest)), "\r\n", ""), 1, 40)).when(
        F.col("id") % 3 == 1, F.substring(digest, 1, 40)
    ).otherwise(F.substring(F.translate(F.base64(F.unhex(F.sha2(digest, 512))), "+/=\r\n", ""), 1, 32))
    parts = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda n: F.get(parts, F.pmod(F.xxhash64(F.col("id"), F.lit(n)), F.lit(len(PARTS))).cast("int"))
    kind = F.col("id") % 4
    ordinary = (
        F.when(kind == 0, F.concat_ws("_", pick(0), pick(1), pick(2), pick(3)))
        .when(kind == 1, F.concat(pick(0), F.initcap(pick(1)), F.initcap(pick(2)), F.initcap(pick(3))))
        .when(kind == 2, F.concat_ws("-", pick(0), pick(1), pick(2), (F.col("id") % 2030).cast("string")))
        .otherwise(F.concat_ws("/", F.lit("https:/"), pick(0), pick(1), pick(2), pick(3)))
    )
    return ids.select(random.alias("token"), F.lit(True).alias("is_random")).unionAll(ids.select(ordinary.alias("token"), F.lit(False).alias("is_random")))


def labelled_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLED_ROWS) -> DataFrame:
    """(token, is_random): the distinct tokens of about ``rows`` documents, labelled by the base kinds, and the generated sample."""
    scale = 1 << 20
    share = min(scale, math.ceil(rows / max(docs.count(), 1) * scale))
    picked = docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(23)), F.lit(scale)) < share))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    values = F.concat(
        F.transform(F.regexp_extract_all(body, F.lit(PATTERNS["assign"]), F.lit(0)), lambda m: F.regexp_replace(m, ASSIGN_HEAD, "")),
        F.regexp_extract_all(body, F.lit(PATTERNS["access"]), F.lit(0)),
        F.regexp_extract_all(body, F.lit(PATTERNS["hex"]), F.lit(0)),
    )
    plain = body
    for kind in BASE_KINDS:
        plain = F.regexp_replace(plain, PATTERNS[kind], " ")
    found = picked.select(values.alias("r"), F.regexp_extract_all(plain, F.lit(f"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"), F.lit(0)).alias("o"))
    random = found.select(F.explode("r").alias("token"), F.lit(True).alias("is_random")).where(F.length("token") >= MIN_ACCESS)
    ordinary = found.select(F.explode("o").alias("token"), F.lit(False).alias("is_random"))
    return random.unionAll(ordinary).distinct().unionAll(generated_sample(docs.sparkSession))


def train(sample: DataFrame) -> list[float]:
    """Log2 likelihood ratios of all transitions between ASCII characters, with add-one-half smoothing.

    ``sample`` has (token, is_random).  What reaches the driver is one count for
    each pair of characters: at most 128 x 128 for each label.
    """
    pairs = (
        sample.where(F.length("token") > 1)
        .select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
        .where(F.col("pair").rlike(r"^[\x00-\x7F]{2}$"))
        .groupBy("is_random", "pair")
        .count()
    )
    counts = {True: [0] * _SIDE**2, False: [0] * _SIDE**2}
    for row in pairs.collect():
        counts[row["is_random"]][ord(row["pair"][0]) * _SIDE + ord(row["pair"][1])] = row["count"]
    alphabet = 66
    ratios = []
    for a in range(_SIDE):
        total = {k: sum(c[a * _SIDE : (a + 1) * _SIDE]) for k, c in counts.items()}
        for b in range(_SIDE):
            p, q = ((counts[k][a * _SIDE + b] + 0.5) / (total[k] + 0.5 * alphabet) for k in (True, False))
            ratios.append(round(math.log2(p / q), 4))
    return ratios


def _ratio(token: Column, table: Column) -> Column:
    """Mean log2 likelihood ratio of a token's transitions."""
    code = lambda i: F.least(F.ascii(F.substring(token, i, F.lit(1))), F.lit(_SIDE - 1))
    steps = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.get(table, code(i) * _SIDE + code(i + 1)))
    return F.aggregate(steps, F.lit(0.0).cast("double"), lambda a, x: a + x) / (F.length(token) - 1)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap, len, value): each match with the length of the text between it and the one before."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = F.filter(zipped, lambda z: z["m"].isNotNull())
    return F.transform(found, lambda z: F.struct(F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), z["m"].alias("value")))


def _placed(matches: Column) -> Column:
    """Array of (start, end, value), by running sums over blocks of matches.

    ``matches`` is named twice below, which keeps Catalyst from moving the
    regular expressions into the lambda.
    """
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int")), lambda b: F.slice(matches, b * _BLOCK + 1, F.lit(_BLOCK))
    )

    def block(state, items):
        inner = F.aggregate(
            items,
            F.struct(state["at"].alias("at"), F.slice(state["none"], 1, 0).alias("out")),
            lambda s, z: F.struct(
                (s["at"] + z["gap"] + z["len"]).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + z["gap"]).alias("start"), (s["at"] + z["gap"] + z["len"]).alias("end"), z["value"].alias("value")))).alias("out"),
            ),
        )
        return inner

    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,end:int,value:string>>>)").alias("out"), empty.alias("none"))

    def step(s, items):
        inner = block(s, items)
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(s["out"], F.array(i["out"])).alias("out"), s["none"].alias("none")))[0]

    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(cut, state, step)["out"])).otherwise(empty)


def find_secrets(docs: DataFrame, ratios: list[float], text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: an array of (start, kind, end) by start, then kind; kinds are numbered as in KINDS."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<gap:int,len:int,value:string>>)")
    names = {k: f"__{into}_{k}" for k in KINDS}
    out = docs
    for kind in KINDS:  # a text without matches costs one search
        out = out.withColumn(names[kind], F.when(body.rlike(PATTERNS[kind]), _matches(body, PATTERNS[kind])).otherwise(none))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # one literal, read once
    good = {
        "assign": lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= MIN_VALUE,
        "access": lambda s: F.length(s["value"]) >= MIN_ACCESS,
        "hex": lambda s: F.lit(True),
        "random": lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (_ratio(s["value"], table) >= MIN_RATIO),
    }
    for kind in KINDS:
        out = out.withColumn(names[kind], F.filter(_placed(F.col(names[kind])), good[kind]))
    part = lambda kind: F.transform(
        names[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))
    )
    base = f"__{into}_base"
    out = out.withColumn(base, F.array_sort(F.concat(*[part(k) for k in BASE_KINDS])))
    alone = F.filter(part("random"), lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn(into, F.array_sort(F.concat(F.col(base), alone))).drop(base, *names.values())


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch covered by spans replaced by MASK; spans that touch or overlap make one stretch."""
    joined = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when((x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (s["at"] == 0)), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(MASK))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])),
    )
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans and all spans for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, train(labelled_sample(docs)))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)],
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
