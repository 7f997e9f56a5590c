"""Problem 8: filling containers of fixed capacity, shortest pack first over the length histogram."""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.plans.layout import cut, spread

CAPACITY = 2048
#: Place of the vocabulary; a parameter of every function that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Groups of one length are ranked in parts, so that no task orders a whole length: so many at least, and one for so many items.
RANK_PARTS, RANKED = 128, 50_000
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def count_tokens(text: str, enc) -> int:
    return len(enc.encode_ordinary(text))


def token_lengths(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens); null texts have 0 tokens."""
    rows = spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [0 if t is None else count_tokens(t, enc) for t in pdf["text"]]})

    return rows.mapInPandas(run, "doc_id long, tokens int")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, containers): packing patterns over a histogram of lengths, longest lengths first.

    Open containers are held as counts of patterns by room left. Items of a length go
    to the containers with the least use, that is with the most room, that they fit in;
    so each length costs one step per pattern it meets, whatever its number of items.
    """
    # Patterns by room: room -> [[lengths, count], ...]; the fullest pack is the one of least room.
    by_room: dict[int, list[list]] = defaultdict(list)
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            # The shortest pack is the open container with the most room.
            room = max((r for r in by_room if by_room[r] and r >= length), default=None)
            if room is None:
                # A new container takes items of this length until no more fit, like any other.
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    by_room[capacity - each * length].append([(length,) * each, full])
                if rest:
                    by_room[capacity - rest * length].append([(length,) * rest, 1])
                break
            lengths, count = by_room[room].pop()
            take = min(count, left)
            if take < count:
                by_room[room].append([lengths, count - take])
            by_room[room - length].append([(*lengths, length), take])
            left -= take
    merged: Counter = Counter()
    for packs in by_room.values():
        for lengths, count in packs:
            merged[lengths] += count
    return sorted(merged.items(), reverse=True)


INTERVALS = T.StructType(
    [T.StructField("length", T.IntegerType()), T.StructField("first_rank", T.LongType()), T.StructField("end_rank", T.LongType()), T.StructField("per", T.IntegerType()), T.StructField("base", T.LongType())]
)


def packing_intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, end_rank, per, base): items of a length and rank in [first, end) go to container
    ``base + (rank - first) // per``.

    There are at most two patterns for each length and 63 different lengths in a pattern of
    2,048, so the table is bounded by the capacity, whatever the number of items.
    """
    used: Counter = Counter()
    out, base = [], 0
    for lengths, count in patterns:
        for length, per in sorted(Counter(lengths).items()):
            out.append((length, used[length], used[length] + per * count, per, base))
            used[length] += per * count
        base += count
    return out


def pack(lengths: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, part_no, first_token, tokens, container) of all items.

    Items longer than a container are split into full parts and a rest. Items of no
    length take no room and go to container 0; null lengths count as none. Repeated
    rows are packed as often as they stand there.
    """
    spark = lengths.sparkSession
    n = F.coalesce(F.col(tokens), F.lit(0))
    items = lengths.select(F.col(key).alias("_key"), n.alias("_n"))
    parts = items.select("_key", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1))).alias("part_no"))
    parts = parts.select("_key", "part_no", (F.col("part_no") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("_n") - F.col("part_no") * capacity).cast("int").alias("length"))
    parts = cut(parts)
    chunks = max(RANK_PARTS, parts.count() // RANKED)
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("_key", "part_no"), F.lit(chunks)).cast("int"))
    # The histogram has at most ``capacity`` rows and its parts as many times that as there are chunks.
    by_chunk = parts.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_chunk.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r.length: r.n for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(packing_intervals(shortest_pack_first(histogram, capacity)), INTERVALS)
    inside = Window.partitionBy("length", "chunk").orderBy("_key", "part_no")
    ranked = parts.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")), "left")
    container = F.coalesce(F.col("base") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per")), F.lit(0))
    return placed.select(F.col("_key").alias(key), "part_no", "first_token", ranked["length"].alias("tokens"), container.cast("long").alias("container"))
