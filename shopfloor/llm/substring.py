"""Substring dedup on sliding sentence spans (operator 2).

A text is cut into sentences, here the stretches that end in a full stop,
question or exclamation mark, comma, colon, semicolon or line break (also their
CJK forms) or before a word with a capital.  A run is consecutive sentences that
are at least ``MIN_SENTENCES`` and have at least ``MIN_WORDS`` words together.
The first occurrence, by doc_id and place, of a repeated run stays, and every
sentence that another occurrence covers is removed.  A passage that starts and
ends inside a sentence is thus found by the sentences that lie whole in it.

Not every run is hashed, but for each sentence the shortest run that starts and
the shortest that ends there, the spans.  They cover what all runs cover: of a
repeated run, a sentence whose own shortest span doesn't fit into the rest lies
in the shortest span that ends where the run ends.  All spans of all documents
are hashed and joined globally.

Three steps keep the shuffles small.  Span hashes are counted (64 bits, reduced
before the shuffle); only spans with a repeated hash go on; those are grouped by
128 bits, so a chance meeting of 64 bits removes nothing.  A span that a third
of all documents hold is one partial count and one partial minimum per task,
and the joins that bring it back are ones that Spark splits.

Defined results: null and empty texts have no sentences and stay as they are;
a text shorter than a span has one span of all its sentences if that has
``MIN_WORDS`` words, else none; rows that repeat doc_id and text are one
document; a null doc_id comes first in the order; letters compare without ASCII
case, blanks around sentences don't count; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, pin, table

MIN_SENTENCES = 2
MIN_WORDS = 20  # shorter repeats are set phrases and notices more often than passages

_STOP, _BLANK, _NEWLINE, _CAPITAL, _SMALL = 1, 2, 3, 4, 5
_KIND = np.array([_NEWLINE if c == "\n" else _STOP if c in ".!?,;:。！？，；：" else _BLANK if c.isspace()
                  else _CAPITAL if c.isupper() else _SMALL if c.islower() else 0 for c in map(chr, range(0x10000))], np.uint8)
_STEP = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone modulo 2 ** 64
_BACK = pow(_STEP, -1, 2**64)


def _last(here: np.ndarray) -> np.ndarray:
    """For every place, where the last True up to it ends; 0 if there is none."""
    return np.maximum.accumulate(np.where(here, np.arange(1, len(here) + 1), 0))


def _cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of the characters, and where sentences start."""
    kind = _KIND[np.minimum(codes, 0xFFFF)]
    between = (kind > 0) & (kind < _CAPITAL)
    at = np.flatnonzero(~between[1:] & between[:-1]) + 1  # where text begins again
    stops = np.concatenate(([0], np.cumsum((kind == _STOP) | (kind == _NEWLINE))))
    capital = (kind[at] == _CAPITAL) & (np.append(kind, 0)[at + 1] == _SMALL)
    return kind, np.concatenate(([0], at[(stops[at] > stops[_last(~between)[at - 1]]) | capital]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def sentences(text: str | None) -> list[str]:
    """The sentences with what follows them; joined they give the text back."""
    if not text:
        return []
    starts = _cut(_codes(text))[1].tolist()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def hashed_sentences(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash and number of words of each sentence, without the blanks
    around it and ASCII case."""
    if not text:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    codes = _codes(text)
    kind, starts = _cut(codes)
    blank = (kind == _BLANK) | (kind == _NEWLINE)
    bounds = np.append(starts, len(codes))
    inside = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))
    words = np.diff(inside[bounds])
    words[1:] += ~blank[starts[1:] - 1]  # a sentence that starts inside a run of characters
    ends = np.maximum(_last(~blank)[bounds[1:] - 1], starts)
    if blank[0]:
        starts = starts.copy()
        starts[0] = min(int(np.argmin(blank)) if not blank.all() else 0, ends[0])
    folded = memoryview(np.where(codes - np.uint32(65) < 26, codes + np.uint32(32), codes).tobytes())
    digests = [xxhash.xxh3_128_digest(folded[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), words


def span_bounds(words: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the different spans start and end (exclusive)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(words)))
    if n < min_sentences and upto[-1] >= min_words:
        return np.array([0]), np.array([n])
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words), np.arange(n) + min_sentences)
    ends = ends[ends <= n]
    # the last span to end at a place is the shortest there; other places have a shortest span of their own
    other = np.setdiff1d(np.arange(ends[0], n + 1) if len(ends) else ends, ends)
    starts = np.minimum(np.searchsorted(upto, upto[other] - min_words, "right") - 1, other - min_sentences)
    return np.concatenate((np.arange(len(ends)), starts)), np.concatenate((ends, other))


def span_hashes(text: str | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS):
    """(h1, h2, start, length) arrays of a text's spans; a span's hash is the
    polynomial of its sentences' hashes, out of two running sums."""
    h, words = hashed_sentences(text)
    n = len(words)
    starts, ends = span_bounds(words, min_sentences, min_words)
    upto = np.zeros((n + 1, 2), np.uint64)
    np.cumsum(h * _powers(_STEP, n)[:, None], axis=0, out=upto[1:])
    spans = (upto[ends] - upto[starts]) * _powers(_BACK, n)[starts, None] + (ends - starts).astype(np.uint64)[:, None]
    return spans[:, 0].view(np.int64), spans[:, 1].view(np.int64), starts, ends - starts


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _spans(docs: DataFrame, columns: str, min_sentences: int, min_words: int) -> DataFrame:
    full = columns != "h1 long"

    def hashes(batches):
        for b in batches:
            for k in range(0, len(b), 128):
                part = b.iloc[k:k + 128]
                got = [span_hashes(t, min_sentences, min_words) for t in part.text]
                out = pd.DataFrame({"h1": np.concatenate([g[0] for g in got])})
                if full:
                    n = [len(g[0]) for g in got]
                    out["h2"], out["start"], out["length"] = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
                    out["th"] = np.repeat(part.th.to_numpy(), n)
                    out["doc_id"] = pd.array(np.repeat(part.doc_id.astype("Int64").to_numpy(dtype=object, na_value=None), n), dtype="Int64")
                yield out

    source = docs.select("doc_id", "text", F.xxhash64("text").alias("th")) if full else docs.select("text")
    return source.mapInPandas(hashes, columns)


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The non-first occurrences: doc_id, th (hash of the text), start, length."""
    often = pin(_spans(docs, "h1 long", min_sentences, min_words).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("h1"), "often")
    columns = "h1 long, h2 long, start int, length int, th long, doc_id long"
    rows = pin(_spans(docs, columns, min_sentences, min_words).join(often, "h1"), "spans")
    place = F.struct("doc_id", "th", "start")
    firsts = pin(rows.groupBy("h1", "h2").agg(F.min(place).alias("first")), "firsts")
    return (rows.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
            .select("doc_id", "th", "start", "length"))


def without_spans(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for t, cover in zip(text, spans, strict=True):
        units = sentences(t)
        gone = np.zeros(len(units) + 1, np.int64)
        for s in cover if cover is not None else ():
            gone[s["start"]] += 1
            gone[s["start"] + s["length"]] -= 1
        out = np.cumsum(gone[:-1]) > 0
        rows.append(("".join(u for u, g in zip(units, out, strict=True) if not g) if out.any() else t, len(units),
                     int(out.sum()), sum(len(u.split()) for u, g in zip(units, out, strict=True) if g)))
    return pd.DataFrame(rows, columns=["text", "n_sentences", "removed_sentences", "removed_words"])


@own_columns("doc_id", "text", new=("n_sentences", "removed_sentences", "removed_words"))
def dedup_substrings(docs: DataFrame, **sizes) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``, plus n_sentences,
    removed_sentences and removed_words."""
    cover = (repeated_spans(docs, **sizes).groupBy("doc_id", "th")
             .agg(F.collect_set(F.struct("start", "length")).alias("__spans"))
             .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__spans"))
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    joined = keyed.join(cover, keyed["doc_id"].eqNullSafe(cover["__id"]) & (F.col("__h") == F.col("__th")), "left")
    new = ("n_sentences", "removed_sentences", "removed_words")
    without = F.pandas_udf(without_spans, "text string, n_sentences int, removed_sentences int, removed_words int")
    return (joined.withColumn("__w", without("text", "__spans"))
            .select(*[F.col("__w.text").alias("text") if c == "text" else F.col(c) for c in docs.columns],
                    *[F.col(f"__w.{c}").alias(c) for c in new]))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with repeated spans removed and what was removed."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
