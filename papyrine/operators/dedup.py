"""Exact, lexical and result deduplication."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import clean_text
from papyrine.operators.graph import bucket_pairs, connected_components
from papyrine.plans.layout import cut, spread

#: Signature length and words of a shingle.
PERMUTATIONS, SHINGLE = 117, 5
PRIME = 2_147_483_647
#: Verified pairs: the similarity, and bands that miss a pair at it with probability (1 - 0.8**4)**29 = 2e-7.
SIMILAR, FINE_BANDS, FINE_ROWS = 0.8, 29, 4
#: Agreeing minima of PERMUTATIONS below which a pair is not verified; one at SIMILAR has fewer with probability 2e-10.
AGREE = 64


def permutation(i: int) -> tuple[int, int]:
    """Multiplier and offset of the i-th hash; a fixed linear congruence, so that any engine can name them."""
    return (i * 48_271 + 16_807) % PRIME or 1, (i * 69_621 + 39_373) % PRIME


def exact_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content_hash, canonical, copies): documents by equal text under their smallest key."""
    h = documents.select(key, F.sha2(F.col(text), 256).alias("content_hash")).where("content_hash is not null")
    g = h.groupBy("content_hash").agg(F.min(key).alias("canonical"), F.count("*").alias("copies"))
    return h.join(g, "content_hash").select(key, "content_hash", "canonical", "copies")


_SPACES = re.compile("[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def shingle_hashes(text: str) -> list[str]:
    """Sorted MD5 of the distinct runs of SHINGLE words of a text."""
    w = [x for x in _SPACES.split(text) if x]
    runs = {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    return sorted(hashlib.md5(r.encode()).hexdigest() for r in runs)


def hashed_shingles(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, xs, h): 28 bits of each shingle's hash, and the hash that names the whole set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, [int(x[:7], 16) for x in sh], hashlib.md5("".join(sh).encode()).hexdigest()) for k, sh in zip(pdf["k"], map(shingle_hashes, pdf["t"])) if sh]
            yield pd.DataFrame(out, columns=[key, "xs", "h"])

    rows = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null"))
    return rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, xs array<long>, h string")


def representatives(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, xs, h): one document of each set of equal shingles, smallest key first."""
    s = hashed_shingles(documents, key, text)
    first = s.groupBy("h").agg(F.min(key).alias(key))
    return s.join(first, ["h", key], "left_semi")


def minhash(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signature): the PERMUTATIONS minima of each representative's shingles.

    A shingle's base hash has 28 bits, so products stay in 64 bits.
    """
    return _sign(representatives(documents, key, text).select(key, "xs"), key).drop("h")


def _sign(shingles: DataFrame, key: str) -> DataFrame:
    """(key, h, signature) of rows (key, xs) that may have h."""
    a, b = (np.array(v, np.int64)[:, None] for v in zip(*map(permutation, range(PERMUTATIONS))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "h": pdf.get("h"), "signature": [((np.asarray(x, np.int64)[None, :] * a + b) % PRIME).min(1) for x in pdf["xs"]]})

    return shingles.mapInPandas(run, f"{key} {dict(shingles.dtypes)[key]}, h string, signature array<long>")


def all_candidate_pairs(signatures: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a, b), a < b: every two representatives that share one of FINE_BANDS bands."""
    bands = F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * FINE_ROWS + 1, FINE_ROWS)) for k in range(FINE_BANDS)])
    return bucket_pairs(cut(signatures.select(F.col(key).alias("id"), F.explode(bands).alias("bucket"))))


def signed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, signature) of every document with shingles, written once, so that texts are shingled once."""
    return cut(_sign(hashed_shingles(documents, key, text), key))


def verified_pairs(documents: DataFrame, threshold: float = SIMILAR, key: str = "doc_id", text: str = "text", signed: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), a < b: representatives whose whole shingle sets have at least the threshold (SIMILAR or more)."""
    if threshold < SIMILAR:
        raise ValueError(f"the bands reach {SIMILAR}")
    kind = dict(documents.dtypes)[key]
    signed = signed or signed_documents(documents, key, text)
    sig = cut(signed.join(signed.groupBy("h").agg(F.min(key).alias(key)), ["h", key], "left_semi").select(key, "signature"))
    pairs = all_candidate_pairs(sig, key)
    x, y = sig.select(F.col(key).alias("a"), F.col("signature").alias("x")), sig.select(F.col(key).alias("b"), F.col("signature").alias("y"))

    def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[(np.stack(pdf["x"]) == np.stack(pdf["y"])).sum(1) >= AGREE, ["a", "b"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "s": [np.unique(np.array([int(h[:15], 16) for h in shingle_hashes(t)], np.int64)).tobytes() for t in pdf["t"]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sims = []
            for x, y in zip(pdf["x"], pdf["y"]):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(both / (len(x) + len(y) - both))
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": sims})
            yield out[out["similarity"] >= threshold]

    few = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(promising, f"a {kind}, b {kind}"))
    named = few.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    held = cut(texts.join(named, "k", "left_semi").mapInPandas(sets, f"k {kind}, s binary"))
    both = few.join(held.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(compare, f"a {kind}, b {kind}, similarity double")


def capped(pairs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` pairs, those of the most linked documents first: the option of a bounded run, off by default."""
    both = pairs.select(F.col("a").alias("x")).union(pairs.select("b"))
    d = both.groupBy("x").agg(F.count("*").alias("d"))
    j = pairs.join(d.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    return j.orderBy(F.greatest("da", "db").desc(), "a", "b").limit(most).select("a", "b")


def clusters(documents: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cluster_id, canonical): components of the links; the longest text stands for each, single documents for themselves."""
    c = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias(key), F.col("component").alias("cluster_id"))
    all_rows = documents.select(key, F.char_length(text).alias("n")).join(c, key, "left").withColumn("cluster_id", F.coalesce("cluster_id", key))
    best = all_rows.groupBy("cluster_id").agg(F.max_by(key, F.struct("n", -F.col(key))).alias("canonical"))
    return all_rows.join(best, "cluster_id").select(key, "cluster_id", "canonical")


def _same_sets(s: DataFrame, key: str) -> DataFrame:
    """(a, b): documents (key, h) of equal shingle sets under their least."""
    return s.join(s.groupBy("h").agg(F.min(key).alias("a")), "h").where(F.col("a") != F.col(key)).select("a", F.col(key).alias("b"))


def verified_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clusters of all documents: equal shingle sets, then verified pairs of different ones."""
    signed = signed_documents(documents, key, text)
    links = verified_pairs(documents, SIMILAR, key, text, signed).select("a", "b")
    return clusters(documents, cut(_same_sets(signed.select(key, "h"), key).unionByName(links)), key, text)


def semantic_clusters(vectors: DataFrame, edges: DataFrame, copies: DataFrame, metrics: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, cluster_id, canonical, size) of every vector: components of the similarity graph.

    ``edges`` (src, dst) link representatives, ``copies`` (rep, id) name equal vectors. The member with
    the greatest metric (key, metric; null counts 0) stands for its cluster, ties by key; single vectors for themselves.
    """
    # Copies follow their representative, so a group of them is never a star in the graph.
    component = connected_components(edges.select("src", "dst")).select(F.col("node").alias("rep"), F.col("component").alias("cluster_id"))
    named = copies.select("rep", F.col("id").alias(key)).join(component, "rep", "left").select(key, F.coalesce("cluster_id", "rep").alias("cluster_id"))
    m = vectors.select(key).join(named, key).join(metrics, key, "left")
    best = representative_by_metric(m, "cluster_id", key, F.col("metric")).withColumnRenamed("representative", "canonical")
    return m.join(best, "cluster_id").select(key, "cluster_id", "canonical", "size")


def representative_by_metric(members: DataFrame, cluster: str, key: str, metric) -> DataFrame:
    """(cluster, representative, size): the member of the greatest metric, ties by key."""
    return members.groupBy(cluster).agg(F.max_by(key, F.struct(F.coalesce(metric, F.lit(0.0)), -F.col(key))).alias("representative"), F.count("*").alias("size"))


def unique_results(results: DataFrame, texts: DataFrame, key: str = "doc_id", cluster: DataFrame | None = None) -> DataFrame:
    """Results of each query without those whose cleaned text, or cluster, came before."""
    r = results.join(texts, key).withColumn("_h", F.sha2(clean_text(F.col("text")), 256))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_h").orderBy("rnk"))).where("_n = 1")
    if cluster is not None:
        r = r.join(cluster, key, "left").withColumn("_c", F.coalesce("cluster_id", key))
        r = r.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_c").orderBy("rnk"))).where("_n = 1").drop("_c", "cluster_id")
    return r.drop("_n", "_h", "text")


def table_groups(tables: DataFrame) -> DataFrame:
    """(signature, tables, columns): tables (name, columns array) of one sorted column set, with what all share."""
    s = tables.withColumn("signature", F.md5(F.array_join(F.array_sort(F.transform("columns", lambda x: F.lower(x))), ",")))
    g = s.groupBy("signature").agg(F.array_sort(F.collect_list("name")).alias("tables"), F.collect_list("columns").alias("all"))
    return g.select("signature", "tables", F.array_sort(F.aggregate("all", F.element_at("all", 1), lambda a, x: F.array_intersect(a, x))).alias("columns"))
