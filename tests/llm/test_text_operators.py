"""Quality, PII, secrets and toxicity against brute force, and on odd input."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import licences, pii, quality, secrets, toxicity
from tessera.llm.textkit import blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, classes string, kept string"
LONG = "der lange Text " * 40_000
ODD = [
    (1, None, None, None, None, None, None, None, None),
    (None, "a b c", "en", None, 5, None, None, None, None),
    (2, "", "en", "s", 0, "x", 1.0, "y", "z"),
    (2, "", "en", "s", 0, "x", 1.0, "y", "z"),
    (3, " \n\t\r\x0b\x0c ", "en", "s", 0, "x", 1.0, "y", "z"),
    (4, LONG, "de", "s", 0, "x", 1.0, "y", "z"),
    (5, "é ß 😀 #$% \n\n a\na\n a\n", "fr", "s", 0, "x", 1.0, "y", "z"),
    (6, "\x00\x1f mail a.b@c.de x", "fr", "s", 0, "x", 1.0, "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)]


def _random_texts(pieces, n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_counts_equal_brute_force():
    texts = _random_texts(["a", "b ", " ", "\n", "é", "# ", "ab ", "\t", "the ", "😀", "\r\n", "x y z\n"], 600, 60, 1) + [r[1] or "" for r in ODD]
    found = quality.measure(pa.array(texts))
    for i, text in enumerate(texts):
        assert [int(found[k][i]) for k in range(5)] == _counts(text), text[:80]


def test_small_blocks_change_nothing():
    texts = _random_texts(["word ", "other\n", "é ", ""], 200, 30, 2)
    whole = [b.spans() for b in blocks(pa.array(texts), 1 << 20)]
    parts = [b.spans() for b in blocks(pa.array(texts), 50)]
    assert sum(len(s[0]) for s in whole) == sum(len(s[0]) for s in parts) > 0


def test_divergence_equals_its_definition():
    rng = np.random.default_rng(3)
    counts, ref = rng.integers(0, 9, (50, 12)), rng.random(12)
    counts[0] = 0
    for row, got in zip(counts, quality.divergence(counts, ref), strict=True):
        if not row.sum():
            assert got == 1
            continue
        p, q = row / row.sum(), ref / ref.sum()
        m = (p + q) / 2
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_quality_on_odd_rows(spark, odd):
    rows = quality.quality(odd, ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.quality(odd.limit(0), ["doc_id"]).count() == 0


def test_quality_keeps_prose_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs, ["doc_id"]).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.5 * len(bad)


def test_copies_and_lone_languages_are_no_reference(spark):
    rng = random.Random(5)

    def text(lang=None, n=400):
        other = lambda: "".join(rng.choice("bcdfghklmnprstaeiou") for _ in range(rng.randint(4, 9)))
        return " ".join(rng.choice(quality.COMMON_WORDS[lang].split()) if lang and rng.random() < 0.45 else other() for _ in range(n))

    copied, lone = text(), text()
    rows = [("en", text("en"), 1) for _ in range(60)] + [("es", text("es"), 1) for _ in range(12)]
    rows += [("es", copied, 0)] * 36 + [("xx", lone, 0), ("en", lone, 0)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string, good int")
    judged = quality.quality(docs, ["doc_id", "good"]).collect()
    assert len(judged) == len(rows) and not any(r.base_failed for r in judged)
    assert all(r.kept == bool(r.good) for r in judged)


def _histograms(text):
    """Both histograms character by character and word by word, normalised."""
    names, stops, spaces = quality.CLASSES, ".,", " \t"
    classes, words = collections.Counter(), collections.Counter()
    for c in text:
        width = len(c.encode())
        kind = ("two", "three", "four")[width - 2] if width > 1 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "space" if c in spaces else "newline" if c in "\n\r" else "stop" if c in stops else "symbol" if c in "#*$%&|<>" else "punctuation" if "!" <= c <= "~" else "control"
        classes[names.index(kind)] += 1
    common = quality.common_words()
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
        word = word[:-1] if word[-1] in ".,;:!?" and len(word) > 1 else word
        words[common.index(word) if word in common else len(common)] += 1
    return [np.array([h[i] for i in range(n)]) / max(sum(h.values()), 1) for h, n in ((classes, len(names)), (words, len(common) + 1))]


def _distance(p, q):
    m = (p + q) / 2
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return np.sqrt(max(kl(p) + kl(q), 0) / 2)


def test_quality_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(10_000 + i, "zz " * (60 + i) + "yy " * i, "xx") for i in range(3)] + [(10_010, None, None), (10_011, "", "en"), (10_012, "der die das " * 40, "en")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(4)
    rows = {r.doc_id: r for r in docs.collect()}
    found = {r.doc_id: r for r in quality.quality(docs, ["doc_id"]).collect()}
    counts = {i: _counts(r.text or "") for i, r in rows.items()}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    shapes = {i: _histograms(r.text or "") for i, r in rows.items()}
    by_lang, every = collections.defaultdict(dict), {}
    for i, r in rows.items():
        if not failed[i]:
            by_lang[r.lang or ""][r.text] = every[r.text] = shapes[i]
    total = [np.mean([s[k] for s in every.values()], axis=0) for k in (0, 1)]
    refs = {}
    for lang, texts in by_lang.items():
        if len(texts) >= max(quality.MIN_TEXTS, sum(map(len, by_lang.values())) / quality.MOST_LANGUAGES):
            refs[lang] = [(sum(s[k] for s in texts.values()) + quality.PRIOR_TEXTS * total[k]) / (len(texts) + quality.PRIOR_TEXTS) for k in (0, 1)]
    assert refs and "xx" not in refs
    limits = (quality.MAX_CLASS_DISTANCE, quality.MAX_WORD_DISTANCE)
    far = lambda n, d: any(d[k] > limit + noise / np.sqrt(max(n, 1)) for k, (limit, noise) in enumerate(limits))
    for i, r in rows.items():
        n = counts[i][0]
        to = lambda ref: [1.0 if not n else _distance(shapes[i][k], ref[k]) for k in (0, 1)]  # noqa: B023, E731
        best = to(refs[r.lang or ""]) if (r.lang or "") in refs else None
        if best is None or far(n, best):
            best = min(([best] if best else []) + [to(refs[x]) for x in sorted(refs)], key=sum)
        got = found[i]
        assert (got.base_failed, got.kept) == (failed[i], not failed[i] and not (n >= 50 and far(n, best))), (i, best)
        if n:
            assert abs(got.class_distance - best[0]) < 1e-6 and abs(got.word_distance - best[1]) < 1e-6


def test_very_many_languages_have_few_references(spark):
    docs = spark.createDataFrame([(i, f"language{i}", " ".join(f"w{i}x{j}" for j in range(60))) for i in range(3000)], "doc_id long, lang string, text string")
    marked = docs.withColumn("__copy", F.col("doc_id"))
    refs = quality.references(quality.features(marked, ["doc_id", "lang", "__copy"]))
    assert refs == {} and quality.quality(docs, ["doc_id"]).where("kept").count() == 3000


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _base_pii(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(g) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans_equal_the_patterns():
    pieces = ["1", "2", "255", "256", ".", "@", "a.b", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "x", "1.2.3", "\n", "é", "::/", "://", "account ", "0004", "٣"]
    anchors = pii.automaton()
    for text in _random_texts(pieces, 15_000, 20, 4):
        assert [s for s in pii.scan(text, anchors) if s[0] < 4] == _base_pii(text), text


def test_pii_added_spans():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.scan(t, pii.automaton()) if k > 3]
    assert found("IBAN DE89 3704 0044 0532 0130 00.")[0] == ("iban", "DE89 3704 0044 0532 0130 00")
    assert ("iban", "DE88370400440532013000") not in found("x DE88370400440532013000")
    assert found("see https://joe:pw@host.example/x") == [("login", "joe:pw")]
    assert found("Account number: 12-345-678 ok") == [("account", "12-345-678")]
    assert found("on no account leave") == []


def test_pii_on_odd_rows(spark, odd):
    rows = {i: r for i, r in enumerate(pii.find_pii(odd.coalesce(1), ["doc_id"]).collect())}
    assert [len(r.spans) for r in rows.values()] == [0] * 7 + [1]
    assert pii.find_pii(odd.limit(0), ["doc_id"]).count() == 0


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def _masked(text, spans):
    out, at = "", 0
    stretches = []
    for a, _, e in sorted(spans):
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], e)
        else:
            stretches.append([a, e])
    for a, e in stretches:
        out, at = out + text[at:a] + secrets.MASK, e
    return out + text[at:]


def test_secrets_equal_brute_force(spark):
    pieces = ["password", "token", ": ", "=", "'", '"', "abc", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "\n", "é😀", "api_key", "x", "Secret", "apikey", "//", "."]
    texts = [*_random_texts(pieces, 1500, 30, 5), "token=abcdefgh " * 3000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    ratios = secrets.train(secrets.generated_sample(spark))
    for row in secrets.find_secrets(docs, ratios).withColumn("masked", secrets.masked(F.coalesce("text", F.lit("")), F.col("spans"))).collect():
        text, spans = row.text or "", [(s.start, s.kind, s.end) for s in row.spans]
        assert [s for s in spans if s[1] < 3] == _base_secrets(text), text
        assert row.masked == _masked(text, spans)


def test_markov_model_tells_random_from_ordinary(spark):
    ratios = secrets.train(secrets.generated_sample(spark))
    tokens = {"aK8s9dfLkj3n4Bv7Qwe2Rt6x": 1, "ghp_A8d7Fh3kLm9Qw2Er5Ty6Ui1Op0Zx": 1, "getUserNameFromTable2020": 0, "my-project-version-12-release": 0, "anexcessivelylongordinaryword": 0}
    docs = spark.createDataFrame([(t, f"see {t} there") for t in tokens], "t string, text string")
    for row in secrets.find_secrets(docs, ratios).collect():
        assert [s.kind for s in row.spans] == [3] * tokens[row.t], row.t


def test_markov_spans_equal_brute_force(spark):
    """The sample, the counts, the ratios and the added spans, recomputed."""
    rng = random.Random(30)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    texts = []
    for i in range(300):
        parts = [word() for _ in range(12)] + ["_".join(word() for _ in range(4)) + str(rng.randint(0, 99))]
        if i % 2:
            parts.append(rng.choice(["", "password=", "é "]) + "".join(rng.choice(alnum) for _ in range(rng.randint(15, 40))))
        if i % 7 == 0:
            parts.append("AKIA" + "".join(rng.choice(alnum[:26] + "0123456789") for _ in range(20)))
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "\n", "; "]).join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "aKd8"), (900, None)], "doc_id long, text string")
    sample = secrets.labelled_sample(docs, rows=10_000)
    tokens = {(r.token, r.is_random) for r in secrets.generated_sample(spark).collect()}
    generated = list(secrets.generated_sample(spark).collect())
    own = set()
    for t in texts:
        left = t
        for m in ASSIGN.finditer(t):
            own.add((m[1], True))
        for pattern in (r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"):
            own.update((x, True) for x in re.findall(pattern, t))
        for pattern in (ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"):
            left = re.sub(pattern, " ", left)
        own.update((x, False) for x in re.findall(r"[A-Za-z0-9+/_=-]{8,}", left))
    own = {x for x in own if not x[1] or len(x[0]) >= 20}
    assert collections.Counter((r.token, r.is_random) for r in sample.collect()) == collections.Counter(own) + collections.Counter((r.token, r.is_random) for r in generated)
    assert tokens and any(k for _, k in own)
    counts = {True: collections.Counter(), False: collections.Counter()}
    for token, kind in [*own, *((r.token, r.is_random) for r in generated)]:
        counts[kind].update(zip(token, token[1:], strict=False))
    total = {k: collections.Counter() for k in counts}
    for k, c in counts.items():
        for (a, _), n in c.items():
            total[k][a] += n

    def ratio(token):
        p = lambda k, a, b: (counts[k][a, b] + 0.5) / (total[k][a] + 0.5 * 66)
        return sum(round(np.log2(p(True, a, b) / p(False, a, b)), 4) for a, b in zip(token, token[1:], strict=False)) / (len(token) - 1)

    added = 0
    for r in secrets.find_secrets(docs, secrets.train(sample)).collect():
        text = r.text or ""
        base = _base_secrets(text)
        expected = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and ratio(m[0]) >= secrets.MIN_RATIO and not any(a < m.end() and m.start() < e for a, _, e in base)]
        added += len(expected)
        assert [(s.start, s.kind, s.end) for s in r.spans] == sorted(base + expected), text
    assert added > 20


def test_secrets_on_odd_rows(spark, odd):
    ratios = secrets.train(secrets.labelled_sample(odd))
    assert secrets.find_secrets(odd, ratios, into="found").where("size(found) = 0").count() == len(ODD)
    assert secrets.find_secrets(odd.limit(0), ratios).count() == 0


def test_toxicity_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    out = toxicity.op2_toxicity(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 500
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.01 * len(out)


def _kneser_ney(docs):
    """Counts, P(w | class), P(w | v, class) and the log ratio by dictionaries; ``docs`` is [(words, toxic)]."""
    words, behind = [collections.Counter(), collections.Counter()], [set(), set()]
    for text, toxic in docs:
        words[toxic].update(set(text))
        behind[toxic].update(zip([None, None, *text], [None, *text], text, strict=False))
    pairs = [collections.Counter((v, w) for _, v, w in found) for found in behind]
    both = words[0] + words[1]
    d2, d1, d0 = toxicity.PAIR_DISCOUNT, toxicity.WORD_DISCOUNT, toxicity.SHARED_DISCOUNT
    lost = lambda counts, d: sum(min(c, d) for c in counts)
    shared = lambda w: max(both[w] - d0, 0) / sum(both.values()) + lost(both.values(), d0) / sum(both.values()) / (len(both) + 1)
    total = [sum(c.values()) for c in words]

    def word(w, k):
        return max(words[k][w] - d1, 0) / total[k] + lost(words[k].values(), d1) / total[k] * shared(w)

    def pair(v, w, k):
        after = {x: n for (u, x), n in pairs[k].items() if u == v}
        if not after:
            return word(w, k)
        n = sum(after.values())
        return max(after.get(w, 0) - d2, 0) / n + lost(after.values(), d2) / n * word(w, k)

    def ratio(v, w):
        return np.log(pair(v, w, 1) / pair(v, w, 0))

    return both, word, pair, ratio


def test_toxicity_equals_kneser_ney_by_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        toxic = int(i % 5 == 0)
        text = [rng.choice(words[: rng.randint(2, 60)]) for _ in range(rng.randint(1, 25))]
        if toxic and rng.random() < 0.9:
            text += rng.choice([["you", "fool"], ["fool"], ["utter", "rubbish"]])
        elif rng.random() < 0.2:
            text += ["you", "there"]
        rows.append((i, text, toxic))
    docs = spark.createDataFrame([(i, " ".join(t).replace("fool", "Fool,")) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    fits = {r.id for r in labels.select(F.col("doc_id").alias("id")).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(toxicity.CURVE_PART)) == 0).collect()}
    both, word, pair, ratio = _kneser_ney([(t, y) for i, t, y in rows if i not in fits])
    assert len(model.pairs.keys) > 0 and len(model.contexts.keys) > 0
    for k in (0, 1):  # each distribution sums to 1 over all words and the unknown one
        assert abs(sum(word(w, k) for w in [*both, "?"]) - 1) < 1e-9
        for v in (None, "you", "utter", "w0", "nowhere"):
            assert abs(sum(pair(v, w, k) for w in [*both, "?"]) - 1) < 1e-9
    texts = [t for _, t, _ in rows[:60]] + [["you", "fool"], ["unseen", "fool"], ["w0"] * 30, []]
    features = []
    for text in texts:
        gains = [np.log1p(toxicity.RATE * np.expm1(ratio(v, w))) for v, w in zip([None, *text], text, strict=False)]
        features.append([sum(gains) / max(len(text), 1), sum(gains) / np.sqrt(max(len(text), 1))])
    got = model.features(pa.array([" ".join(t) for t in texts]))
    assert np.allclose(got, features, rtol=1e-9, atol=1e-12)
    bias, *slopes = model.curve
    expected = 1 / (1 + np.exp(-(bias + np.array(features) @ np.array(slopes))))
    assert np.allclose(model.score(pa.array([" ".join(t) for t in texts])), expected)


def test_toxicity_scores(spark):
    docs = spark.createDataFrame([(i, f"common words here {'awful' if i % 3 == 0 else 'fine'} number{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    scores = toxicity.train(docs, labels).score(pa.array(["awful", "Awful, awful!", "fine", "", None, "unseen words"]))
    assert scores[0] > 0.9 and scores[1] > 0.9 and scores[2] < 0.5 and scores[3] == scores[4]


def test_toxicity_learns_both_sides_at_an_even_balance(spark):
    docs = spark.createDataFrame([(i, f"common words here {'awful' if i % 2 else 'fine'} number{i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (model.words.values > 0).any() and (model.words.values < 0).any()
    marked, plain, unseen = model.score(pa.array(["awful", "fine", "unseen"]))
    assert marked > 0.9 and plain < 0.1 and marked > unseen > plain


def test_toxicity_keeps_every_expression(spark):
    long = " ".join(f"{i * 2654435761 % 4294967296:08x}" for i in range(110_000))
    docs = spark.createDataFrame([(i, long if i < 12 else "other words") for i in range(24)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(24)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels).words.keys) > 109_000


def test_toxicity_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert [r.score for r in toxicity.score(odd, model, ["doc_id"]).collect()] == [pytest.approx(0, abs=1e-6)] * len(ODD)
    one = spark.createDataFrame([(4, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, one), ["doc_id"]).where("score < 0.9").count() == 0
    assert toxicity.score(odd.limit(0), model, ["doc_id"]).count() == 0


def _licences(text, threshold=licences.THRESHOLD):
    """Every statement against every template, without pruning."""
    low = (text or "").lower()
    found = {}
    for statement in re.split(r"[.!?;]+\s+|[\r\n]+", low) + re.split(r"[.!?;]+\s+", re.sub(r"[\r\n]", " ", low)) + [low]:
        a = set(licences.bigrams(statement))
        best = min(((-2 * len(a & set(b)) / (len(a) + len(b)), name) for name, t in licences.TEMPLATES if (b := licences.bigrams(t))), default=(0, ""))
        if a and -best[0] >= threshold:
            found[best[1]] = max(found.get(best[1], 0), -best[0])
    return sorted(found.items())


def test_licences_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [t for _, t in licences.TEMPLATES]
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 4)):
            body = rng.choice(licences.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                place = rng.randrange(len(body))
                body[place : place + rng.randint(0, 2)] = rng.choice([[], ["other"], ["the", "licence"], ["été"]])
            parts.append((rng.choice(["\n", " ", "  "])).join(body) + rng.choice([".", ". ", "", "\n", "; "]))
        texts.append(rng.choice(["\n", " ", ". Then more words stand here. "]).join(parts))
    texts += ["Copyright 2020 A. Person\n\n" + t.replace(". ", ".\n\n").replace(", ", ",\n") for _, t in licences.TEMPLATES[:5]]
    texts += [None, "", "no licence here", "ALL RIGHTS RESERVED", "Ⅻ All rights reserved é.", "word " * 5000 + "\nReleased under the MIT License.\n" + "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("found", F.lit(1))
    for r in licences.scan(docs).collect():
        assert [(x.licence, pytest.approx(x.dice)) for x in r.found] == _licences(r.text), r.text
    assert licences.scan(docs.limit(0)).count() == 0
