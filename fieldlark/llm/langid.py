"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1 bits. For each bit a binary classifier on
hashed n-grams of bytes tells the languages with +1 from those with -1; its weights
are log ratios of the n-gram frequencies of both groups, its scale and offset are
fitted on the sample. Decoding adds up, bit by bit, the loss of the classifier's
margin against each codeword, weighted by how reliable the classifier is, and takes
the codeword of the least loss; a prediction is ambiguous if the next one is near.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.session import cut_lineage

SAMPLE = 1000  # different labelled texts per language to learn from
DIMENSIONS = 1 << 13
ORDERS = (2, 3, 4)  # bytes in an n-gram
UNKNOWN = "und"
AMBIGUOUS = 0.6  # share of the best language below which a prediction is ambiguous
QUANTILE = 0.99  # of the least losses of the texts learned from: a text above it is in doubt
SHARE = 0.1  # of the loss of a text without any evidence: a text above it is in great doubt
# how often two letters of a text are equal: 0.06 to 0.09 in prose in Latin letters, less in other scripts; 0.04 in random
# Latin letters, 0.05 in random consonants, 0.17 and more in hex digits and repetitions
RANDOM, REPEATED, FEW_LETTERS = 0.052, 0.15, 0.3
ENOUGH = 100, 20  # letters from which on the first and the second of them can be told
TRAINERS = 8  # tasks over the sample

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def codewords(n: int) -> np.ndarray:
    """A row of bits per language. Up to six languages have the exhaustive code: every way to split them in two.
    More have the best of seeded random codes by the least distance of two rows."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, np.int8).T
    draw, best, distance = np.random.Generator(np.random.PCG64(5)), None, -1
    bits = 8 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(0, dtype=int)) == n).any():
            continue
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if least > distance:
            best, distance = code, least
    return best


def has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


def features(text: str | None) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased letters of a text, words held apart by one space."""
    data = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS)
    for n in ORDERS:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ raw[k: len(raw) - n + 1 + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    scale: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # of each bit's classifier
    limits: tuple[float, float] | None = None  # least losses from which on a text is in doubt, and in great doubt

    def margins(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        return counts @ self.weights / total * self.scale + self.offset

    def losses(self, counts: np.ndarray) -> np.ndarray:
        return self.decoded(self.margins(counts))

    def decoded(self, m: np.ndarray) -> np.ndarray:
        """Loss of the margins of each row against each codeword."""
        loss = np.logaddexp(0, -m[:, None, :] * self.code[None])
        return (loss * self.trust).sum(2)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of all languages' weights, whether it is ambiguous) of each row."""
        loss = self.losses(counts)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = share[np.arange(len(best)), best]
        return best, score, score < AMBIGUOUS


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a one-dimensional logistic regression with a slight pull to zero, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([(x * (p - y)).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step /= max(1, np.abs(step).max() / 5)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from at most *sample* different texts per language (a bound set by this parameter), with whole texts.

    The texts of the smallest hashes are drawn, one copy of each; so every language with a text is learned, however
    often its texts occur. Rows without a language, or without a letter, teach nothing; None if no row is left.
    """
    rows = labelled.select(F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64("text"))
    keys = cut_lineage(rows.groupBy("lang", "key").agg(F.lit(1).alias("n")).select("lang", "key"), "langid-texts")
    sizes = {r.lang: r.n for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # some more than the sample by a rate, of which the smallest are taken: no task gets all texts of a language
    more = sample + 10 * sample ** 0.5 + 30
    rate: Column = F.element_at(
        F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, more / n))))), F.col("lang"))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    taken = keys.where(place < rate * (1 << 40)).withColumn(
        "__n", F.row_number().over(Window.partitionBy("lang").orderBy(place, "key"))).where(F.col("__n") <= sample).drop("__n")

    def one_copy(batches):
        seen = set()
        for batch in batches:
            own = []
            for i, pair in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist())):
                if pair not in seen:
                    seen.add(pair)
                    own.append(i)
            yield batch.take(pa.array(own, pa.int64()))

    copies = rows.join(F.broadcast(taken), ["lang", "key"]).select("text", "lang", "key")  # taken: *sample* a language
    drawn = copies.mapInArrow(one_copy, copies.schema).dropDuplicates(["lang", "key"]).select("text", "lang")
    drawn = cut_lineage(drawn.repartition(TRAINERS), "langid-sample")

    def profiles(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    counts = features(text)
                    sums[lang] = sums.get(lang, 0) + counts / counts.sum()
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()])], names=["lang", "sums"])

    total: dict[str, np.ndarray] = {}
    for r in drawn.mapInArrow(profiles, "lang string, sums binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(bytes(r.sums))
    languages = sorted(total)
    if not languages:
        return None
    share = np.array([total[x] / total[x].sum() for x in languages])
    code = codewords(len(languages))
    smooth, weights = 0.1 / DIMENSIONS, np.zeros((DIMENSIONS, code.shape[1]))
    for b in range(code.shape[1]):
        plus, minus = code[:, b] > 0, code[:, b] < 0
        if minus.any():
            weights[:, b] = np.log((share[plus].mean(0) + smooth) / (share[minus].mean(0) + smooth))
    ones = np.ones(code.shape[1])
    model = Model(languages, code, weights, ones, 0 * ones, ones)
    sent = drawn.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for batch in batches:
            texts, langs = (batch.column(c).to_pylist() for c in ("text", "lang"))
            own = [(t, x) for t, x in zip(texts, langs) if has_letter(t)]
            for a in range(0, len(own), 64):
                m = sent.value.margins(np.array([features(t) for t, _ in own[a: a + 64]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for _, x in own[a: a + 64]]), pa.array([row.tobytes() for row in m])],
                    names=["lang", "margins"])

    seen = drawn.mapInArrow(margins, "lang string, margins binary").collect()
    x = np.array([np.frombuffer(bytes(r.margins)) for r in seen])
    y = code[[languages.index(r.lang) for r in seen]] > 0
    scale, offset, trust = ones.copy(), 0 * ones, ones.copy()
    if len(languages) > 1:
        for b in range(code.shape[1]):
            scale[b], offset[b] = _logistic(x[:, b], y[:, b])
            wrong = (((x[:, b] * scale[b] + offset[b]) > 0) != y[:, b]).mean()
            trust[b] = np.log((1 - wrong + 1e-3) / (wrong + 1e-3))
        trust = np.maximum(trust, 0)
        trust = trust / trust.mean() if trust.any() else ones
    model = Model(languages, code, weights, scale, offset, trust)
    if len(languages) > 1:  # one language has no bits to tell anything by
        least = np.concatenate([model.decoded(x[a: a + 1024] * scale + offset).min(1) for a in range(0, len(x), 1024)])
        none = model.losses(np.zeros((1, DIMENSIONS))).min()
        limit = float(np.quantile(least, QUANTILE))
        model.limits = limit, max(limit, SHARE * float(none))
    return model


def identify(df: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """*df* with lang_pred, score and ambiguous (columns of these names are replaced).

    A null text, and one without a letter, is ``und`` with score 0, and so is every text without a model. Ties go to
    the language first in alphabetical order. Whole texts count, each row by itself; an empty table stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            lang, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for a in range(0, len(known), 64):
                at = known[a: a + 64]
                best, s, near = model.predict(np.array([features(texts[i]) for i in at]))
                for i, b in zip(at, best):
                    lang[i] = model.languages[b]
                score[at], ambiguous[at] = s, near
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang), pa.array(score), pa.array(ambiguous)],
                names=[*(c for c in batch.schema.names if c != "__text"), "lang_pred", "score", "ambiguous"])

    kept = [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")]
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_column}`").alias("__text"))
    schema = source.drop("__text").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def like_prose(text: str, great_doubt: bool = True) -> bool:
    """Whether the letters of a text may be distributed as in some language: not repeated as in no language and, where
    nine tenths of them are a-z, not all about equally frequent. Without great doubt only repetitions of very few letters
    are none. True where letters are too few to tell."""
    counts = Counter(c for c in text.lower() if c.isalpha())
    n = sum(counts.values())
    if n < ENOUGH[1]:
        return True
    equal = sum(k * (k - 1) for k in counts.values()) / (n * (n - 1))
    if not great_doubt:
        return equal <= FEW_LETTERS
    latin = sum(k for c, k in counts.items() if c < "\x80") >= 0.9 * n
    return equal <= REPEATED and not (latin and n >= ENOUGH[0] and equal < RANDOM)


def with_language(df: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """Rows of *df* whose text is in a language. Texts without a letter go. So do those that the decoder finds no codeword
    near enough for, by a quantile of the texts it learned from, unless their letters are distributed as in prose: they
    may be in a language without labels. Without a model only texts without a letter go."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            if model is not None and model.limits is not None:
                doubt, great = model.limits
                known = [i for a in range(0, len(known), 64) for i, loss in zip(
                    known[a: a + 64], model.losses(np.array([features(texts[i]) for i in known[a: a + 64]])).min(1))
                    if loss <= doubt or like_prose(texts[i], loss > great)]
            yield batch.take(pa.array(known, pa.int64()))

    return df.mapInArrow(run, df.schema)
