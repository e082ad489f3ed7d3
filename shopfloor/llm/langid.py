"""Language identification with hyperdimensional profiles (operator 10).

Every letter owns a random vector of +1/-1.  A trigram binds its letters: the
first letter's vector rotated twice, times the second's rotated once, times the
third's.  A text bundles (adds) the vectors of all its trigrams, a language's
prototype bundles the unit vectors of its training documents, and a document
gets the language whose prototype has the largest cosine with it.

Letters are the Unicode letters, lower-cased; any run of other characters is
one boundary symbol, also at both ends of the text.  Texts are read whole, in
pieces of ``PIECE`` symbols whose vectors add up, so a text of any length needs
bounded memory.  Trigrams without a letter don't count.

The prototypes are fitted on a bounded sample: about ``sample_per_lang``
training documents of each language, picked by a hash of doc_id.  They are sums
of integers, so they don't depend on the order of rows.  The model, at most
``max_langs`` x ``DIM`` numbers, is the only thing sent to the executors.

Cosines are rounded to nine decimals, so that they don't depend on how texts
are batched.

Defined results: a null text or one without a letter is ``und`` with score 0;
if nothing can be learned, every text is ``und``; ties go to the first language
in code point order; a null lang teaches nothing; repeated rows are predicted
one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table

DIM = 1024
PIECE = 1 << 16  # symbols of a text that are encoded at once
BATCH = 1 << 16  # symbols of several texts that are encoded together
_SCALE = 1 << 20  # training vectors are rounded to this fraction, so that sums are exact


def _letter_table() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all other code points."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


class Encoder:
    """Texts to bundled trigram vectors."""

    def __init__(self, dim: int = DIM, seed: int = 10):
        self.dim, self.seed = dim, seed
        self.letters = _letter_table()
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.vectors:
            bits = np.random.default_rng([self.seed, letter]).integers(0, 2, self.dim, dtype=np.int8)
            self.vectors[letter] = (2 * bits - 1).astype(np.int8)
        return self.vectors[letter]

    def symbols(self, text: str | None) -> np.ndarray:
        """Letters with one 0 for each run of others and at both ends; empty without a letter."""
        codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        s = np.concatenate(([0], self.letters[codes], [0])).astype(np.int64)
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        return s if len(s) > 1 else s[:0]

    def bundle(self, pieces: list[np.ndarray]) -> np.ndarray:
        """One vector for each piece: the sum of its trigrams' vectors."""
        alphabet, ids = np.unique(np.concatenate(pieces), return_inverse=True)
        n, sizes = len(alphabet), np.array([len(p) for p in pieces])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inside = owner[2:] == owner[:-2]
        grams = ((ids[:-2] * n + ids[1:-1]) * n + ids[2:])[inside]
        if not len(grams):
            return np.zeros((len(pieces), self.dim), np.float32)
        inverse, grams = pd.factorize(grams)
        counts = np.bincount(owner[2:][inside] * len(grams) + inverse, minlength=len(pieces) * len(grams))
        book = np.stack([self.vector(int(c)) for c in alphabet])
        first, second = np.roll(book, 2, axis=1), np.roll(book, 1, axis=1)
        out = np.zeros((len(pieces), self.dim), np.float32)
        counts = counts.reshape(len(pieces), len(grams)).astype(np.float32)
        for k in range(0, len(grams), 2048):
            g = grams[k:k + 2048]
            bound = first[g // (n * n)] * second[g // n % n] * book[g % n]
            out += counts[:, k:k + 2048] @ bound.astype(np.float32)
        return out

    def encode(self, texts) -> np.ndarray:
        """A row for each text; zeros for texts without a letter."""
        out = np.zeros((len(texts), self.dim), np.float64)
        pieces, owners, waiting = [], [], 0

        def flush():
            if pieces:
                np.add.at(out, owners, self.bundle(pieces))
                pieces.clear()
                owners.clear()

        for i, text in enumerate(texts):
            s = self.symbols(text)
            for k in range(0, max(0, len(s) - 2), PIECE):
                pieces.append(s[k:k + PIECE + 2])
                owners.append(i)
                waiting += len(pieces[-1])
                if waiting >= BATCH:
                    flush()
                    waiting = 0
        flush()
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def chunks(n: int, step: int = 256) -> Iterator[slice]:
    return (slice(k, k + step) for k in range(0, n, step))


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id, as text, leaves 1 by 3 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_prototypes(docs: DataFrame, sample_per_lang: int = 2000, max_langs: int = 2000, seed: int = 10,
                   partitions: int = 24) -> dict[str, np.ndarray]:
    """Unit prototype of every language among the training documents."""
    training = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages to learn")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items())
                           for x in (lang, min(1_000_000, 1_000_000 * sample_per_lang // n + 1))])
    sample = (training.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
              .repartition(partitions, "doc_id"))

    def bundle(batches):
        encoder, sums = Encoder(), {}
        for b in batches:
            for rows in chunks(len(b)):
                vectors = np.rint(unit(encoder.encode(list(b.text[rows]))) * _SCALE).astype(np.int64)
                for lang, v in zip(b.lang[rows], vectors, strict=True):
                    sums[lang] = sums[lang] + v if lang in sums else v
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    totals: dict[str, np.ndarray] = {}
    for r in sample.mapInPandas(bundle, "lang string, vector array<long>").toLocalIterator():
        totals[r.lang] = totals.get(r.lang, 0) + np.array(r.vector, np.int64)
    totals = {k: v for k, v in totals.items() if v.any()}
    return {k: unit(totals[k].astype(np.float64)[None])[0] for k in sorted(totals)}


def predictor(prototypes: dict[str, np.ndarray]):
    """A column function: text to struct(lang, score)."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIM))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for texts in batches:
            parts = [pd.DataFrame({"lang": pd.Series(dtype=str), "score": pd.Series(dtype=float)})]
            for rows in chunks(len(texts)):
                vectors = unit(encoder.encode(list(texts[rows])))
                known = vectors.any(axis=1) & bool(names)
                cosines = np.round(vectors @ matrix.T, 9) if names else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                parts.append(pd.DataFrame({
                    "lang": np.where(known, np.array(names or ["und"], object)[best], "und"),
                    "score": np.where(known, np.clip(cosines.max(axis=1), 0.0, 1.0), 0.0)}))
            yield pd.concat(parts[1:] or parts, ignore_index=True)

    return predict


@own_columns("doc_id", "text", "lang")
def identify(docs: DataFrame, **options) -> DataFrame:
    """Every document with its predicted language and the cosine behind it."""
    predict = predictor(fit_prototypes(docs, **options))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))


@own_columns("doc_id", "text", "lang")
def keep_known(docs: DataFrame, min_score: float = 0.0, **options) -> DataFrame:
    """Documents whose language is known with at least ``min_score``; the
    columns of ``docs`` unchanged."""
    predict = predictor(fit_prototypes(docs, **options))
    p = "__langid"
    return (docs.withColumn(p, predict(F.col("text")))
            .filter((F.col(f"{p}.lang") != "und") & (F.col(f"{p}.score") >= min_score))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: the predicted language of every whole text."""
    return identify(table(spark, sf_dir, "documents"))
