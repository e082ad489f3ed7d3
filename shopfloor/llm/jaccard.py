"""N-gram Jaccard join on signature trees (operator 4).

Documents whose sets of word shingles have a Jaccard similarity of at least
``percent`` / 100 are linked, and every document gets the class of documents it
reaches by links.

*Signatures.*  A set has a bitmap of ``BITS`` bits, the OR of one bit for each
shingle, and its size.  Of two sets a and b, at least as many shingles of a are
missing in b as bits of a are missing in b's bitmap, which bounds the overlap
from above.  A signature tree holds in each node the OR of its members' bitmaps,
their range of sizes and their least number of bits; two trees are traversed
together, and a pair of nodes is dropped when even the largest possible overlap
is too small for a link, or when all members are in one class already.

*Blocks.*  One tree over a corpus would be compared with itself everywhere, so
trees are built for blocks of documents: those that agree in ``ROWS`` of the
min-hashes of their sets, for ``BANDS`` independent choices.  Two sets at 0.85
miss all blocks with a probability of (1 - 0.85 ** ROWS) ** BANDS = 6e-12, and
more similar ones with less; verification is exact.

*No quadratic work in a group of copies.*  Equal sets are one class from the
start.  First each block's members are paired with three hubs only; verified pairs
make classes by connected components.  Only then are the trees of blocks that
still hold several classes traversed, for pairs of different classes; verifying
those makes the result complete.  Blocks of more than ``BLOCK`` members are
split, and each pair of parts is a task's work of its own.

Defined results: words are runs of characters other than blanks, A-Z lower-cased;
a text with fewer words than a shingle is one shingle; null, empty and blank
texts have no shingles, link with nothing and are their own class; rows that
repeat a doc_id are judged by their texts and may meet in one class; a null
doc_id is in its class like others, but names it only if there is no other;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, own_columns, pin, table
from .components import components

BITS = 2048
ROWS = 4
BANDS = 35
BLOCK = 1024
FAN = 16

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


class _Words(dict):
    """Word to hash; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, cache: dict, n: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    found = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - width + 1 + j])
    return np.unique(out)


def _hash_constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**64, (n, 1), dtype=np.uint64),
            rng.integers(0, 2**64, (n, 1), dtype=np.uint64) | np.uint64(1))


def band_keys(of: np.ndarray, add: np.ndarray, times: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` min-hashes."""
    least = np.full(len(add), 2**64 - 1, np.uint64)
    for k in range(0, len(of), 1024):
        least = np.minimum(least, ((of[None, k:k + 1024] ^ add) * times).min(axis=1))
    keys = np.arange(1, len(add) // rows + 1, dtype=np.uint64)
    for m in least.reshape(-1, rows).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + m)
    return keys


def bitmap(of: np.ndarray, bits: int = BITS) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[(of >> np.uint64(20)) % np.uint64(bits)] = 1
    return np.packbits(flags)


def signatures(docs: DataFrame, n: int = 4, rows: int = ROWS, bands: int = BANDS, seed: int = 4) -> DataFrame:
    """One row per document: its set's size, 128-bit identity, band keys and bitmap."""
    def sign(batches):
        cache = _Words()
        add, times = _hash_constants(rows * bands, seed)
        for b in batches:
            for k in range(0, len(b), 128):
                part = b.iloc[k:k + 128]
                out = []
                for text in part.text:
                    s = shingle_set(text, cache, n)
                    if len(s):
                        s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                        out.append((len(s), s1, s2, band_keys(s, add, times, rows).view(np.int64).tolist(), bitmap(s).tobytes()))
                    else:
                        out.append((0, 0, 0, [], b""))
                frame = pd.DataFrame(out, columns=["n", "s1", "s2", "keys", "bits"])
                frame["doc_id"] = part.doc_id.astype("Int64").to_numpy(dtype=object, na_value=None)
                frame["doc_id"] = frame.doc_id.astype("Int64")
                frame["th"] = part.th.to_numpy()
                yield frame

    return (docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
            .mapInPandas(sign, "doc_id long, th long, n long, s1 long, s2 long, keys array<long>, bits binary"))


class SignatureTree:
    """Members of a block in order of class and size, ``FAN`` children a node.

    A level holds, for each node: OR of bitmaps, smallest and largest size,
    least number of bits, first and last class."""

    def __init__(self, size: np.ndarray, words: np.ndarray, label: np.ndarray):
        self.order = np.lexsort((size, label))
        size, words, label = size[self.order], words[self.order], label[self.order]
        ones = np.bitwise_count(words).sum(axis=1).astype(np.int64)
        self.levels = [(words, size, size, ones, label, label)]
        while len(self.levels[-1][0]) > 1:
            words, low, high, ones, first, last = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            ends = np.append(starts[1:], len(low)) - 1
            self.levels.append((np.bitwise_or.reduceat(words, starts, axis=0), np.minimum.reduceat(low, starts),
                                np.maximum.reduceat(high, starts), np.minimum.reduceat(ones, starts),
                                first[starts], last[ends]))

    def children(self, depth: int, i: int) -> np.ndarray:
        return np.arange(i * FAN, min((i + 1) * FAN, len(self.levels[depth - 1][0])))


def possible(one: tuple, other: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the node pairs (i, j) may hold a link between two classes."""
    (words_a, low_a, high_a, ones_a, first_a, last_a) = (x[i] for x in one)
    (words_b, low_b, high_b, ones_b, first_b, last_b) = (x[j] for x in other)
    common = np.bitwise_count(words_a & words_b).sum(axis=1).astype(np.int64)
    # every member of a lacks at least so many of its shingles in every member of b, and the other way round
    lack_a, lack_b = np.maximum(ones_a - common, 0), np.maximum(ones_b - common, 0)
    most = np.minimum(high_a - lack_a, high_b - lack_b)
    # a link needs overlap * (100 + percent) >= percent * (sum of sizes); the largest overlap is the easiest case
    sizes = np.maximum(low_a, most + lack_a) + np.maximum(low_b, most + lack_b)
    one_class = (first_a == last_a) & (first_b == last_b) & (first_a == first_b)
    return np.flatnonzero(~one_class & ((100 + percent) * most >= percent * sizes))


def traverse(a: SignatureTree, b: SignatureTree, itself: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the blocks' rows of the member pairs that may be linked."""
    da, db = len(a.levels) - 1, len(b.levels) - 1
    found_a, found_b = [], []
    todo = [(da, db, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        da, db, i, j = todo.pop()
        keep = possible(a.levels[da], b.levels[db], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if da == db == 0:
            ok = i < j if itself else np.ones(len(i), bool)
            found_a.append(a.order[i[ok]])
            found_b.append(b.order[j[ok]])
            continue
        down_a, down_b = da >= db, db >= da
        for k in range(0, len(i), 64):  # bounded sets of pairs at once
            pairs = [np.meshgrid(a.children(da, x) if down_a else x, b.children(db, y) if down_b else y)
                     for x, y in zip(i[k:k + 64], j[k:k + 64], strict=True) if not (itself and x > y)]
            if pairs:
                todo.append((da - down_a, db - down_b, np.concatenate([p[0].ravel() for p in pairs]),
                             np.concatenate([p[1].ravel() for p in pairs])))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_a) if found_a else empty), (np.concatenate(found_b) if found_b else empty)


def _words(bits: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def block_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different classes that may be linked, out of rows
    (key, part_a, part_b, left, c, root, n, bits) that share key and parts."""
    def search(batches):
        rest = None
        for b in batches:
            b = pd.concat([rest, b], ignore_index=True) if rest is not None else b
            if not len(b):
                continue
            k = b[["key", "part_a", "part_b"]].to_numpy()
            edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            cut = edges[-1] if len(edges) else 0
            rest = b.iloc[cut:]
            yield from blocks(b.iloc[:cut], edges)
        if rest is not None and len(rest):
            k = rest[["key", "part_a", "part_b"]].to_numpy()
            yield from blocks(rest, np.append(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(rest)))

    def blocks(b, ends):
        if not len(b):
            return
        c, words = b.c.to_numpy(), _words(b.bits)
        size, root, left = b.n.to_numpy(), b.root.to_numpy(), b.left.to_numpy()
        itself = (b.part_a == b.part_b).to_numpy()
        got_a, got_b, start = [], [], 0
        for end in ends:
            at = np.arange(start, end)
            if root[start:end].min() != root[start:end].max():
                if itself[start]:
                    tree = SignatureTree(size[at], words[at], root[at])
                    i, j = traverse(tree, tree, True, percent)
                    pair = at[i], at[j]
                else:
                    one, other = at[left[at]], at[~left[at]]
                    if not len(one) or not len(other):
                        start = end
                        continue
                    i, j = traverse(SignatureTree(size[one], words[one], root[one]),
                                    SignatureTree(size[other], words[other], root[other]), False, percent)
                    pair = one[i], other[j]
                got_a.append(c[pair[0]])
                got_b.append(c[pair[1]])
            start = end
        if got_a:
            x, y = np.concatenate(got_a), np.concatenate(got_b)
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    return (rows.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b")
            .select("key", "part_a", "part_b", "left", "c", "root", "n", "bits").mapInPandas(search, "a long, b long"))


def _bounded(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link."""
    @F.pandas_udf("long")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.bitwise_count(_words(x) & _words(y)).sum(axis=1).astype(np.int64)) if len(x) else pd.Series([], dtype="int64")

    sized = pairs
    for s in "ab":
        sized = sized.join(marks.select(F.col("c").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")), s)
    return (sized.filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
            .withColumn("common", common("bits_a", "bits_b"))
            .withColumns({"ones_a": common("bits_a", "bits_a"), "ones_b": common("bits_b", "bits_b")})
            .withColumn("most", F.least(F.expr("n_a - ones_a + common"), F.expr("n_b - ones_b + common")))
            .filter(100 * F.col("most") >= percent * (F.col("n_a") + F.col("n_b") - F.col("most")))
            .select("a", "b"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int = 4) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets; texts: c, text."""
    def check(batches):
        cache = _Words()
        for b in batches:
            ok = []
            for x, y in zip(b.text_a, b.text_b, strict=True):
                s, t = shingle_set(x, cache, n), shingle_set(y, cache, n)
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield b.loc[ok, ["a", "b"]]

    both = pairs
    for s in "ab":
        both = both.join(texts.select(F.col("c").alias(s), F.col("text").alias(f"text_{s}")), s)
    return both.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


@own_columns("doc_id", "text")
def jaccard_classes(docs: DataFrame, percent: int = 85, n: int = 4, rows: int = ROWS, bands: int = BANDS,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of every row."""
    signed = pin(signatures(docs, n, rows, bands).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    full = signed.filter("n > 0")
    # small tables that are joined back are written, so that Spark can split a hot side of the join
    classes = pin(full.groupBy("s1", "s2").agg(F.min("uid").alias("c"), F.min("doc_id").alias("least_id")), "classes")
    members = pin(full.select("uid", "doc_id", "th", "n", "s1", "s2").join(classes, ["s1", "s2"])
                  .select("uid", "doc_id", "th", "n", "c", "least_id"), "members")
    reps = members.filter("uid = c").select("c")
    marks = pin(full.join(reps, F.col("uid") == F.col("c")).select("c", "n", "bits", "keys", "doc_id", "th"), "marks")

    # each block's members with three hubs
    keys = marks.select("c", F.explode("keys").alias("key"))
    some = F.array_distinct(F.array(F.min("c"), F.max("c"), F.min_by("c", F.xxhash64("c"))))
    hubs = pin(keys.groupBy("key").agg(some.alias("hubs"), F.count(F.lit(1)).alias("members")).filter("members > 1")
               .select("key", "hubs"), "hubs")
    shared = pin(keys.join(hubs, "key"), "blocks")
    stars = (shared.select("c", F.explode("hubs").alias("hub")).filter("hub <> c")
             .select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b")).distinct())
    size_of = marks.select("c", "n", "bits")
    tried = pin(_bounded(stars, size_of, percent), "stars")
    wanted = shared.select("c").distinct()
    named = (marks.select("c", "doc_id", "th").join(wanted, "c")
             .select("c", F.col("doc_id").alias("d"), F.col("th").alias("t")))
    texts = pin(docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
                .join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
                .select("c", "text").dropDuplicates(["c"]), "texts")
    links = pin(verified(tried, texts, percent, n), "links")

    # blocks that still hold several classes
    roots = components(links)
    labelled = (shared.join(roots, F.col("c") == F.col("node"), "left")
                .select("key", "c", F.coalesce("root", "c").alias("root")))
    open_ = pin(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"))
                .filter("lo <> hi").select("key", F.ceil(F.col("members") / block).cast("int").alias("parts")), "open")
    part = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    split = (labelled.join(open_, "key").withColumn("part", part)
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", F.least("part", "with").alias("part_a"), F.greatest("part", "with").alias("part_b"),
                     (F.col("part") <= F.col("with")).alias("left"), "c", "root")
             .join(size_of, "c"))
    rest = pin(block_candidates(split, percent).distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
    more = verified(rest, texts, percent, n)
    for s in "ab":  # between classes
        more = (more.join(roots.withColumnsRenamed({"node": f"node_{s}", "root": f"root_{s}"}), F.col(s) == F.col(f"node_{s}"), "left")
                .withColumn(s, F.coalesce(f"root_{s}", s)))
    tops = components(more.select("a", "b")).withColumnsRenamed({"node": "low", "root": "top"})

    classed = (members.join(roots, F.col("c") == F.col("node"), "left")
               .withColumn("root", F.coalesce("root", "c"))
               .join(tops, F.col("root") == F.col("low"), "left")
               .select("doc_id", "th", "n", "least_id", F.coalesce("top", "root").alias("root")))
    names = pin(classed.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    return (classed.join(names, "root").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id")
            .union(signed.filter("n = 0").select("doc_id", "th", "n", F.col("doc_id"))))


@own_columns("doc_id", "text")
def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; the
    columns of ``docs`` unchanged.  Rows of that document that are repeated, and
    documents without shingles, stay."""
    kept = (jaccard_classes(docs, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    return (keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__id"]) & (F.col("__h") == F.col("__th")), "left_semi")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: size of each document's set and its class."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
