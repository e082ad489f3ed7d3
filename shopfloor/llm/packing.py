"""Best-fit packing of documents into sequences with certified repacking (operator 11).

A document's token ids, closed by an end id, are one piece; a document longer
than a sequence is cut from its end, into whole sequences and a shorter first
piece.  Whole pieces are sequences by themselves.  The others are dealt to
partitions by a hash of their row number and packed there by best-fit
decreasing: the longest piece first, each into the fullest sequence that still
has room for it.

Dual feasible functions give a lower bound on the sequences that a set of
lengths needs: such a function f satisfies sum f(x) <= f(C) for all lengths
that fit into one sequence of C together, so sum f(x) / f(C), rounded up, can't
be beaten.  Two families are used, with all their parameters.  The function that
gives the best bound over all lengths also gives each partition its share of it, and
a partition that meets its share, rounded up, is certified.  The others, those with
gaps, give up their sequences that aren't full, a certified one its emptiest, and the
given up documents are dealt anew among them and packed again, as long as the
bound of all lengths isn't met and a round saves sequences.

A partition holds about ``part_rows`` numbers at any size of the input; the
driver sees the counts of the ``capacity`` lengths and one number a round.

Defined results: a null or empty text is the end id alone; repeated rows and
rows without doc_id are packed one by one; texts of any length are cut;
sequences of an empty table are an empty result; only doc_id and text are read,
so other names can't clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, pin, table

CAPACITY = 1024
END_ID = 2
PART_ROWS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long"
PLACES = "uid long, length long, bin long, offset long, fill long, gap int"

#: Characters whose classes all versions of Unicode agree on.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library; special
    tokens' strings in a text are ordinary text.

    Texts of plain characters go through tiktoken with the file's own merges, which
    gives the same ids in a quarter of the time, if the file's ids are in the
    order of its merges (as tiktoken needs); all other texts through tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if spec.get("normalizer") is None and [vocabulary[m] for m in merged] == list(range(256, 256 + len(merged))):
            import public_tokenizers
            import tiktoken
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merged)}
            self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document with their ids."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            texts, ids, rows, places = b.column("text"), [], [], []
            for i in range(b.num_rows):
                doc = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                ids.append(doc)
                for k, (start, n) in enumerate(cuts(len(doc), capacity)):
                    rows.append(i)
                    places.append((k, start, n, zlib.crc32(doc[start:start + n].tobytes())))
            piece, start, length, crc = (np.array(places, np.int64).reshape(-1, 4)).T
            ends = np.append(0, np.cumsum(length)).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's fill.  Bins are kept by the room
    they have left; the bits of ``rooms`` say which rooms occur."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        enough = rooms >> n
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            with_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


@cache
def _dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all functions at 0..capacity, a row a function, and f(capacity)."""
    x, c = np.arange(capacity + 1), capacity
    cut_off = [np.where(x > c - p, c, np.where(x < p, 0, x)) for p in range(c // 2 + 1)]
    halves = [np.where(2 * x > c, 2 * (c // p - (c - x) // p), np.where(2 * x == c, c // p, 2 * (x // p))) for p in range(1, c // 2 + 1)]
    f = np.array(cut_off + halves, np.int64)
    return f, f[:, c]


def best_bound(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray, int]:
    """Lower bound on the bins for ``counts[x]`` pieces of each length x, and the function
    that gives it, as f(0..capacity) and f(capacity)."""
    f, whole = _dual_feasible(capacity)
    bounds = -(-(f @ counts.astype(np.int64)) // whole)
    at = int(bounds.argmax())
    return int(bounds[at]), f[at], int(whole[at])


def bins_needed(counts: np.ndarray, capacity: int) -> int:
    return best_bound(counts, capacity)[0]


def _packed(sizes: DataFrame, n_parts: int, capacity: int, turn: int, f: np.ndarray, whole: int) -> DataFrame:
    """``sizes`` (uid, length) dealt to ``n_parts`` partitions and packed there; gap is
    the partition's number of bins above its share of the bound that ``f`` gives."""
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        gap = len(fills) - -(-int(f[lengths].sum()) // whole)
        home = (turn << 52) + (int(key[0]) << 24)
        return pd.DataFrame({"uid": part["uid"], "length": lengths, "bin": home + bins, "offset": offsets, "fill": fills[bins], "gap": gap})

    part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(n_parts)).alias("part")
    return sizes.select(part, "uid", "length").groupBy("part").applyInPandas(pack, PLACES)


def _bins(places: DataFrame) -> int:
    return places.filter("offset = 0").count()


def _given_up(places: DataFrame, capacity: int) -> DataFrame:
    """``places`` with ``out``: whether its bin is given up."""
    part = F.shiftright("bin", 24)
    emptiest = (places.filter((F.col("gap") == 0) & (F.col("offset") == 0)).groupBy(part.alias("part"))
                .agg(F.min_by("bin", F.struct("fill", "bin")).alias("least")).select("least"))
    return (places.join(emptiest, F.col("bin") == F.col("least"), "left")
            .withColumn("out", (F.col("fill") < capacity) & ((F.col("gap") > 0) | F.col("least").isNotNull())).drop("least"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, max_turns: int = 8) -> DataFrame:
    """``sizes``: uid and length (1 to ``capacity``).  Returns uid, sequence_id and
    offset of each; pieces as long as a sequence are placed alone."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    counts[capacity] = 0
    rows = int(counts.sum())
    needed, f, whole = best_bound(counts, capacity)
    alone = sizes.filter(F.col("length") == capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_parts = max(1, -(-rows // part_rows))
    places = pin(_packed(sizes.filter(F.col("length") < capacity), n_parts, capacity, 0, f, whole), "places")
    used, settled = _bins(places), []
    for turn in range(1, max_turns + 1):
        if used <= needed or n_parts == 1:
            break
        marked = pin(_given_up(places, capacity), "marked")
        out = marked.filter("out")
        n, old = out.count(), _bins(out)
        n_parts = max(1, -(-n // part_rows))
        again = pin(_packed(out, n_parts, capacity, turn, f, whole), "places")
        new = _bins(again)
        if new >= old:
            break
        settled.append(marked.filter("not out"))
        places, used = again, used - old + new
    for kept in settled:
        places = places.unionByName(kept.drop("out"))
    return alone.unionByName(places.select("uid", F.col("bin").alias("sequence_id"), "offset"))


@own_columns("doc_id", "text")
def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   part_rows: int = PART_ROWS) -> DataFrame:
    """Every piece with its ids, its sequence and its place there: doc_id, piece, start,
    length, ids, ids_crc32, sequence_id, offset.  The ids are read from a written table
    and only if they are used."""
    pieces = pin(token_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id)
                 .withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity, part_rows), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the doc_id, piece and offset of what
    is in them.  A sequence holds at most its capacity, so no group is large."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(inside.alias("s"))
            .select("sequence_id", F.flatten("s.ids").alias("ids"), F.col("s.doc_id").alias("doc_ids"),
                    F.col("s.piece").alias("pieces"), F.col("s.offset").alias("offsets")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
