"""URL filters on Bloom filter cascades (operator 3).

A cascade answers exactly, for every key of a known universe, whether the key
is listed.  Level 1 is a Bloom filter of the listed keys; level 2 one of the
keys of the universe that level 1 lets through wrongly; level 3 one of the
listed keys that level 2 holds wrongly, and so on until no wrong key is left.
A key is listed if the first level that doesn't hold it has an even number (or
if all levels hold it and their number is odd).  The filters are small, are
broadcast, and replace joins.

Two cascades judge the pages.  The first encodes the rules' keys over all keys
that the corpus's urls offer: each of the host's last labels with each prefix of
the path that is as long as some rule's path.  The longest key held is the url's
rule.  The second encodes listed hosts over all hosts: a host with a page under
a block rule is listed, and its pages under no rule are blocked.

Universes are built by one distributed distinct (a hot host is one key, reduced
before the shuffle), levels by distributed ORs of filter words; the driver sees
filter words only, at most ``max_filter_mb`` of them for each level, and more is
an error.

Defined results: a null url or one without :// has an empty host and path, which
fit no rule, and is allowed; repeated pages are judged one by one; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, pin, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter; ``depth`` gives every level its own hash functions."""
    depth: int
    bits: int
    hashes: int
    words: np.ndarray | None = None

    def places(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """hashes x keys."""
        steps = np.arange(1, self.hashes + 1, dtype=np.uint64)[:, None] + np.uint64(self.depth << 8)
        return _mix(k1[None, :] + steps * (k2[None, :] | np.uint64(1))) % np.uint64(self.bits)

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        at = self.places(k1, k2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def sized_level(depth: int, n: int, rate: float, max_filter_mb: int) -> Level:
    bits = max(64, -(-int(n * math.log(1 / rate) / math.log(2) ** 2) // 64) * 64)
    if bits > max_filter_mb * 8_000_000:
        raise ValueError(f"a filter of {n} keys needs {bits // 8_000_000} MB; max_filter_mb is {max_filter_mb}")
    return Level(depth, bits, max(1, round(math.log(1 / rate) / math.log(2))))


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        k1, k2 = np.asarray(k1, np.int64).view(np.uint64), np.asarray(k2, np.int64).view(np.uint64)
        out = np.full(len(k1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(k1))
        for i, level in enumerate(self.levels):
            held = level.holds(k1[open_], k2[open_])
            out[open_[~held]] = i % 2 == 1
            open_ = open_[held]
        return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    """128 bits that stand for a key."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _build(keys: DataFrame, level: Level) -> Level:
    def words(batches):
        for b in batches:
            at = level.places(b.k1.to_numpy(np.int64).view(np.uint64), b.k2.to_numpy(np.int64).view(np.uint64)).ravel()
            at = np.unique(at)
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

    got = keys.mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    level.words = np.zeros(level.bits // 64, np.uint64)
    if got:
        level.words[[r.word for r in got]] = np.array([r.bits for r in got], np.int64).view(np.uint64)
    return level


def _held(keys: DataFrame, level: Level) -> DataFrame:
    words = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for b in batches:
            yield b[words.value.holds(b.k1.to_numpy(np.int64).view(np.uint64), b.k2.to_numpy(np.int64).view(np.uint64))]

    return keys.mapInPandas(keep, keys.schema)


def build_cascade(universe: DataFrame, rate: float = 0.01, deep_rate: float = 0.05, max_filter_mb: int = 64) -> Cascade:
    """``universe``: one row per key (k1 long, k2 long, listed boolean)."""
    inside, outside = universe.filter("listed").select("k1", "k2"), universe.filter("not listed").select("k1", "k2")
    levels: list[Level] = []
    n = inside.count()
    while n:
        level = _build(inside, sized_level(len(levels), n, deep_rate if levels else rate, max_filter_mb))
        levels.append(level)
        wrong = pin(_held(outside, level), "cascade")
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def offered_keys(rules) -> Column:
    """The keys by which some rule might fit (host, path), as an array."""
    depths = range(1, 1 + max(h.count(".") + 1 for h, _, _ in rules))
    host, path = F.col("host"), F.col("path")
    return F.array_distinct(F.filter(F.array(*[
        F.when((F.size(F.split(host, r"\.", -1)) >= d) & (F.length(path) >= n) & (host != ""),
               F.concat(F.substring_index(host, ".", -d), F.substring(path, 1, n)))
        for d in depths for n in sorted({len(p) for _, p, _ in rules})]), lambda k: k.isNotNull()))


def _pair_tester(cascade: Broadcast):
    @F.pandas_udf("boolean")
    def test(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(cascade.value.listed(k1.to_numpy(), k2.to_numpy()))
    return test


def _array_tester(cascade: Broadcast):
    @F.pandas_udf("array<boolean>")
    def test(k1: pd.Series, k2: pd.Series) -> pd.Series:
        sizes = k1.map(len).to_numpy(np.int64)
        if not sizes.sum():
            return pd.Series([[] for _ in k1])
        flat = cascade.value.listed(np.concatenate(k1.to_list()), np.concatenate(k2.to_list()))
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]))
    return test


def judge_urls(pages: DataFrame, rules=RULES, **sizes) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    sc = pages.sparkSession.sparkContext
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", offered_keys(rules))

    strings = [h + p for h, p, _ in rules]
    k1, k2 = key_hashes(F.col("key"))
    universe = (urls.select(F.explode("keys").alias("key")).distinct()
                .select(k1.alias("k1"), k2.alias("k2"), F.col("key").isin(strings).alias("listed")))
    in_rules = _array_tester(sc.broadcast(build_cascade(pin(universe, "url-keys"), **sizes)))
    held = in_rules(F.transform("keys", lambda k: key_hashes(k)[0]), F.transform("keys", lambda k: key_hashes(k)[1]))
    # the longest of the held keys; of equally long ones the one with the longer host
    best = F.array_max(F.transform(
        F.filter(F.arrays_zip(F.col("keys").alias("key"), F.col("held").alias("held")), lambda x: x["held"]),
        lambda x: F.struct(F.length(x["key"]).alias("n"), F.length(F.substring_index(x["key"], "/", 1)).alias("h"),
                           x["key"].alias("key"))))
    verdicts = F.create_map(*[F.lit(x) for (h, p, v) in rules for x in (h + p, v)])
    ruled = pin(urls.withColumn("held", held).withColumn("rule", best["key"]).select("page_id", "host", "path", "rule")
                .withColumn("ruled", verdicts[F.col("rule")]), "url-rules")

    h1, h2 = key_hashes(F.col("host"))
    hosts = (ruled.groupBy("host").agg(F.max(F.coalesce(F.col("ruled") == "block", F.lit(False))).alias("listed"))
             .select(h1.alias("k1"), h2.alias("k2"), "listed"))
    in_hosts = _pair_tester(sc.broadcast(build_cascade(pin(hosts, "url-hosts"), **sizes)))
    return (ruled.withColumn("listed", in_hosts(h1, h2))
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: rule and verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), cut AS (
  SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest
), parts AS (
  SELECT page_id,
         coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(r, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM cut
), rules(rh, rp, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS ruled
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
), judged AS (
  SELECT p.page_id, p.host, p.path, f.rule, f.ruled FROM parts p LEFT JOIN fits f USING (page_id)
), listed AS (
  SELECT DISTINCT host FROM judged WHERE ruled = 'block'
)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.ruled, CASE WHEN l.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN listed l USING (host)
"""
