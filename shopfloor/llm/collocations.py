"""Phrase collocations from FM-indexes over word ids (operator 13).

Documents are indexed in shards of at most ``shard_words`` words of one
language.  A shard's words get ids, its pieces become one text with a separator
between them, and the text is sorted by the next ``DEPTH`` words of every place:
the order of an FM-index for patterns up to that length.  Phrases are intervals
of that order.  An interval is extended to the right by the words that follow
inside it, and to the left through the Burrows-Wheeler transform: the places
whose left neighbour is c, in order, are the places of c (the last-to-first
mapping), so the runs of equal (c, interval) in that mapping are the intervals
of c + phrase.  All intervals of a level are extended at once; their lengths
are the counts.  Nothing longer than ``DEPTH`` words is visited.

The shards' counts meet by phrase and are summed.  A phrase is one row a shard
however often it occurs, so a very common phrase is as many rows as there are
shards.  The parts of a candidate occur at least as often as the candidate.  So
words and pairs are summed first, and a second pass extends only intervals of
pairs that are frequent in the whole corpus, and only to triples whose other pair
is frequent too.  Which pairs are frequent is sent to the tasks as a Bloom filter
of at most ``FILTER_BITS`` bits, whatever their number: a false positive is a
triple that is counted for nothing, none is missed, and with too many pairs for
the filter it merely saves less.

Defined results: null texts have no words; a null language is ``und``; repeated
rows count each time; long texts are cut into shards at pieces, never inside;
an empty table gives an empty result; columns other than text and lang are not
read, so their names can't clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, pin, table

DEPTH = 3
#: Words of one shard's index; its arrays take about 60 bytes a word.
SHARD_WORDS = 2_000_000
#: Largest filter of frequent pairs, 64 MB; it has about 12 bits a pair up to there.
FILTER_BITS = 2**29
_PROBES, _PAGE = 4, 2**16

#: Everything that ends a piece, as a line break.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)

COUNTS = "lang string, k int, phrase string, a long"


def pieces(text: bytes | None) -> list[list[bytes]]:
    """The words of each piece of a UTF-8 text, A-Z lower-cased (``bytes.lower`` touches no
    others); pieces without words are left out.  After the cut only blanks and tabs
    are left of what ``split`` splits at."""
    found = (p.split() for p in (text or b"").lower().translate(_ENDS).split(b"\n"))
    return [p for p in found if p]


class WordText:
    """A shard's text: word ids from 1, and 0 after every piece."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.text = array("i")
        self.n = 0

    def add(self, piece: list[bytes]) -> None:
        ids = self.ids
        self.text.extend([ids.setdefault(w, len(ids) + 1) for w in piece])
        self.text.append(0)
        self.n += len(piece)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and each place's run."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _places_in_order(text: np.ndarray, n_ids: int) -> np.ndarray:
    """All places of the text, sorted by the ``DEPTH`` symbols from there on (circular)."""
    keys = [np.roll(text, -d) for d in range(DEPTH)]
    if n_ids ** DEPTH < 2**62:
        joined = keys[0].astype(np.int64)
        for k in keys[1:]:
            joined = joined * n_ids + k
        return np.argsort(joined, kind="stable")
    return np.lexsort(keys[::-1])


class Index:
    """The intervals of phrases of one and two words of a text that ends in 0."""

    def __init__(self, text: np.ndarray, n_ids: int):
        places = _places_in_order(text, n_ids)
        self.n = len(text)
        self.first, self.second = text[places], np.roll(text, -1)[places]
        self.before = np.roll(text, 1)[places]  # the Burrows-Wheeler transform
        self.pairs, self.pair_at = _runs(self.first, self.second)

    def _level(self, starts: np.ndarray, *columns: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.column_stack(columns)
        keep = (ids != 0).all(axis=1) & (True if keep is None else keep)
        return ids[keep], np.diff(np.append(starts, self.n))[keep]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        starts, _ = _runs(self.first)
        return self._level(starts, self.first[starts])

    def extended_right(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' intervals, extended by the words that follow."""
        return self._level(self.pairs, self.first[self.pairs], self.second[self.pairs])

    def extended_left(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``known`` pairs, extended by the words before them, where those
        and the pair's first word are a known pair as well."""
        place = np.argsort(self.before, kind="stable")  # the last-to-first mapping, turned round
        inside = self.pair_at[place]
        starts, _ = _runs(self.before[place], inside)
        inside = inside[starts]
        return self._level(starts, self.before[place][starts], self.first[self.pairs][inside], self.second[self.pairs][inside],
                           keep=known[inside] & known[self.pair_at[starts]])


def pair_hashes(lang: str, words: list[bytes] | list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of the pairs words[one[i]], words[two[i]]."""
    seed = xxhash.xxh3_64_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))
    x = h[one] * np.uint64(0x9E3779B97F4A7C15) + h[two]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.array([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(_PROBES)], np.int64)


def pair_filter(pairs: DataFrame, bits: int | None = None) -> bytes:
    """A Bloom filter of ``pairs`` (lang, phrase).  Pages of the bitmap are put together
    in the tasks; the driver gets the finished ones."""
    if bits is None:
        bits = min(FILTER_BITS, max(8 * _PAGE, 1 << int(12 * pairs.count()).bit_length()))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, phrases in b.groupby("lang")["phrase"]:
                words = [w for p in phrases for w in p.split(" ")]
                even = np.arange(0, len(words), 2)
                at = np.unique(_probes(pair_hashes(lang, words, even, even + 1), bits))
                yield pd.DataFrame({"page": at // (8 * _PAGE), "place": at % (8 * _PAGE)})

    def page(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(8 * _PAGE, np.uint8)
        flags[found["place"].to_numpy()] = 1
        return pd.DataFrame({"page": [key[0]], "bitmap": [np.packbits(flags, bitorder="little").tobytes()]})

    pages = (pairs.select("lang", "phrase").mapInPandas(places, "page long, place long").distinct()
             .groupBy("page").applyInPandas(page, "page long, bitmap binary"))
    out = np.zeros((bits // (8 * _PAGE), _PAGE), np.uint8)
    for r in pages.collect():  # at most FILTER_BITS bits
        out[r.page] = np.frombuffer(r.bitmap, np.uint8)
    return out.tobytes()


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _probes(hashes, 8 * len(bitmap))
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _counted(lang: str, shard: WordText, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of the shard's words and pairs or, with the filter of frequent pairs, of its
    triples; the phrase of no words counts all words."""
    def batch(k, phrases, counts):
        n = len(phrases)
        return pa.RecordBatch.from_arrays(
            [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([lang])).cast(pa.string()),
             pa.array(np.full(n, k, np.int32)), phrases, pa.array(counts.astype(np.int64))], ["lang", "k", "phrase", "a"])

    names = [b"", *shard.ids]
    words = pa.array(names, pa.binary()).cast(pa.string())
    index = Index(np.frombuffer(shard.text, np.int32).copy(), len(names))
    if bitmap is None:
        yield batch(0, pa.array([""]), np.array([shard.n]))
        levels = [index.words(), index.extended_right()]
    else:
        known = _known(bitmap, pair_hashes(lang, names, index.first[index.pairs], index.second[index.pairs]))
        levels = [index.extended_left(known)]
    del index
    step = 200_000
    for ids, counts in levels:
        for at in range(0, len(ids), step):
            columns = [words.take(pa.array(c)) for c in ids[at:at + step].T]
            phrases = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
            yield batch(len(columns), phrases, counts[at:at + step])


def shard_counts(docs: DataFrame, shard_words: int = SHARD_WORDS, known_pairs: bytes | None = None) -> DataFrame:
    """Counts of all words and pairs or, given the filter of frequent pairs, of the triples
    made of them; a row a shard and phrase.  A task keeps one open shard a language
    and closes the largest when they hold ``2 * shard_words`` words together."""
    sent = None if known_pairs is None else docs.sparkSession.sparkContext.broadcast(known_pairs)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if sent is None else np.frombuffer(sent.value, np.uint8)
        open_: dict[str, WordText] = {}
        held = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                for piece in pieces(text.as_py()):
                    shard = open_.setdefault(lang, WordText())
                    shard.add(piece)
                    held += len(piece)
                    full = lang if shard.n >= shard_words else None
                    if full is None and held >= 2 * shard_words:
                        full = max(open_, key=lambda x: open_[x].n)
                    if full is not None:
                        held -= open_[full].n
                        yield from _counted(full, open_.pop(full), bitmap)
        while open_:
            yield from _counted(*open_.popitem(), bitmap)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(index, COUNTS)


def _summed(counts: DataFrame, min_count: int) -> DataFrame:
    """Rows are dealt by phrase before anything is summed: a shard has a phrase once,
    so summing in the map tasks would hold all phrases for little."""
    return (counts.repartition("lang", "phrase").groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))
            .filter((F.col("k") == 0) | (F.col("a") >= min_count)))


@own_columns("text", "lang")
def phrase_counts(docs: DataFrame, min_count: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, k, phrase and a (occurrences) of phrases of 1 to ``DEPTH`` words with at
    least ``min_count`` occurrences, and k = 0: all words of the language."""
    short = pin(_summed(shard_counts(docs, shard_words), min_count), "phrases")
    known = pair_filter(short.filter("k = 2"))
    return short.unionByName(pin(_summed(shard_counts(docs, shard_words, known), min_count), "triples"))


def _part(counts: DataFrame, k: int, name: str) -> DataFrame:
    return counts.filter(F.col("k") == k).select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"),
                                                 F.col("a").alias(f"{name}_a"))


def collocations(docs: DataFrame, min_count: int = 10, covered_percent: int = 50, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Phrases of two and three words that stay candidates: lang, phrase, a, l and r
    (occurrences of the two parts at the lowest-scoring cut), n (words of the language)
    and score, floor(10^6 a^2 / (l r))."""
    counts = phrase_counts(docs, min_count, shard_words)
    score = lambda l, r: F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")

    def with_part(df, words, k, name):
        part = _part(counts, k, name)
        return df.withColumn("_p", words).join(part, (F.col("lang") == F.col(f"{name}_lang")) & (F.col("_p") == F.col(f"{name}_phrase"))).drop(
            "_p", f"{name}_lang", f"{name}_phrase")

    w = F.split("phrase", " ")
    pairs = counts.filter("k = 2").select("lang", "phrase", "a")
    pairs = with_part(with_part(pairs, w[0], 1, "l"), w[1], 1, "r").withColumn("score", score("l_a", "r_a"))
    pairs = pairs.select("lang", "phrase", "a", F.col("l_a").alias("l"), F.col("r_a").alias("r"), "score")

    triples = counts.filter("k = 3").select("lang", "phrase", "a")
    head, tail = F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2])
    cut = with_part(with_part(with_part(with_part(triples, w[0], 1, "l1"), tail, 2, "r1"), head, 2, "l2"), w[2], 1, "r2")
    cut = cut.withColumns({"s1": score("l1_a", "r1_a"), "s2": score("l2_a", "r2_a")})
    early = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    cut = cut.select("lang", "phrase", "a", pick("l1_a", "l2_a").alias("l"), pick("r1_a", "r2_a").alias("r"), pick("s1", "s2").alias("score"))

    longest = (triples.select("lang", F.explode(F.array(head, tail)).alias("inner"), F.col("a").alias("longer"))
               .groupBy("lang", "inner").agg(F.max("longer").alias("longer"))
               .select(F.col("lang").alias("c_lang"), "inner", "longer"))
    covered = 100 * F.col("longer") >= covered_percent * F.col("a")
    open_pairs = (pairs.join(longest, (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("inner")), "left")
                  .filter(F.col("longer").isNull() | ~covered).select(*pairs.columns))
    words = counts.filter("k = 0").select("lang", F.col("a").alias("n"))
    return open_pairs.unionByName(cut).join(words, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """The ``top`` best of each language with their rank, ties by more occurrences, then
    by phrase; Spark limits each task's rows before they meet."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (collocations(docs, **options).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of each language of ``documents``."""
    return top_collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
one AS (SELECT lang, u AS p, count(*) AS a FROM (SELECT lang, unnest(w) AS u FROM piece) GROUP BY ALL),
two AS (
  SELECT lang, u[1] AS x, u[2] AS y, u[1] || ' ' || u[2] AS p, count(*) AS a
  FROM (SELECT lang, unnest(list_zip(w[:-2], w[2:])) AS u FROM piece WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10),
three AS (
  SELECT lang, u[1] AS x, u[2] AS y, u[3] AS z, u[1] || ' ' || u[2] || ' ' || u[3] AS p, count(*) AS a
  FROM (SELECT lang, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS u FROM piece WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM one GROUP BY ALL),
pair AS (
  SELECT two.lang, two.p, two.a, l.a AS l, r.a AS r,
         (1000000::HUGEINT * two.a * two.a) // (l.a::HUGEINT * r.a) AS score
  FROM two JOIN one l ON l.lang = two.lang AND l.p = two.x JOIN one r ON r.lang = two.lang AND r.p = two.y
  WHERE NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = two.lang AND 100 * t.a >= 50 * two.a
                    AND (t.x || ' ' || t.y = two.p OR t.y || ' ' || t.z = two.p))),
cuts AS (
  SELECT t.lang, t.p, t.a, l1.a AS l1, r1.a AS r1, l2.a AS l2, r2.a AS r2,
         (1000000::HUGEINT * t.a * t.a) // (l1.a::HUGEINT * r1.a) AS s1,
         (1000000::HUGEINT * t.a * t.a) // (l2.a::HUGEINT * r2.a) AS s2
  FROM three t
  JOIN one l1 ON l1.lang = t.lang AND l1.p = t.x JOIN two r1 ON r1.lang = t.lang AND r1.p = t.y || ' ' || t.z
  JOIN two l2 ON l2.lang = t.lang AND l2.p = t.x || ' ' || t.y JOIN one r2 ON r2.lang = t.lang AND r2.p = t.z),
kept AS (
  SELECT lang, p, a, l, r, score FROM pair
  UNION ALL
  SELECT lang, p, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, p) AS rank,
         p AS phrase, a, l, r, n.n, score::BIGINT AS score
  FROM kept JOIN n ON n.lang = kept.lang)
WHERE rank <= 2000
"""
