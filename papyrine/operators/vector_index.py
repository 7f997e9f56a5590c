"""Product codes over rotated vectors: an index that is searched by code, grows by appends and is trained again as a whole."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import catalog, dense
from papyrine.operators.sparse import top_k

#: Vectors the rotation and the code books are fitted on, at most (the smallest hashes); every row is coded.
SAMPLE = 50_000
#: Parts of a vector, codes of a part, and candidates of a batch that are scored exactly for each result wanted.
PARTS, CODES, RESCORED = 8, 16, 20


class Codes:
    """A rotation and a code book for each part of the rotated vector."""

    def __init__(self, rotation: np.ndarray, books: list[np.ndarray]):
        self.rotation, self.books = rotation, books
        self.width = rotation.shape[0] // len(books)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.rotation
        return [y[:, p * self.width : (p + 1) * self.width] for p in range(len(self.books))]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.argmin((c * c).sum(1) - 2 * y @ c.T, axis=1) for y, c in zip(self.parts(x), self.books)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries x parts x codes) products of each query's parts with the codes."""
        return np.stack([y @ c.T for y, c in zip(self.parts(queries), self.books)], axis=1)

    def to_json(self) -> str:
        return json.dumps({"rotation": self.rotation.tolist(), "books": [b.tolist() for b in self.books]})

    @staticmethod
    def from_json(text: str) -> Codes:
        d = json.loads(text)
        return Codes(np.array(d["rotation"]), [np.array(b) for b in d["books"]])


def balanced_rotation(x: np.ndarray, parts: int) -> np.ndarray:
    """Principal directions dealt out so that the parts hold alike much of the variance, the greatest first to the part that has least."""
    values, vectors = np.linalg.eigh(x.T @ x)
    width = x.shape[1] // parts
    held, taken = np.zeros(parts), [[] for _ in range(parts)]
    for i in np.argsort(-values):
        p = min((p for p in range(parts) if len(taken[p]) < width), key=lambda p: held[p])
        taken[p].append(i)
        held[p] += np.log(max(values[i], 1e-12)) + 30
    return vectors[:, [i for t in taken for i in t]]


def fit(vectors: DataFrame, key: str = "doc_id", vector: str = "embedding", parts: int = PARTS, codes: int = CODES, seed: int = 42) -> Codes:
    """Rotation and code books of unit vectors; the number of parts divides the dimension."""
    x = dense._sample(vectors, key, vector, SAMPLE)
    while x.shape[1] % parts:
        parts -= 1
    rotation = balanced_rotation(x, parts)
    width = x.shape[1] // parts
    y = x @ rotation
    return Codes(rotation, [dense.centroids_of(y[:, p * width : (p + 1) * width], codes, seed + p) for p in range(parts)])


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(a, np.float64) for a in v])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def coded(vectors: DataFrame, model: Codes, vector: str = "embedding") -> DataFrame:
    """Adds ``pq``, the codes as bytes; rows without a vector of the model's dimension are left out."""
    rows = vectors.where(F.size(vector) == model.rotation.shape[0])
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(pq=[c.tobytes() for c in held.value.encode(_unit(pdf[vector]))])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, pq binary")


def search(index: DataFrame, model: Codes, queries: DataFrame, k: int = 10, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, score, rnk): the k best by code of a stated set of queries (qid, qvec), of which the first are scored exactly.

    Every row is scored by table look-ups of its codes; each batch scores its RESCORED * k best on the
    vectors themselves and passes on k. Queries are taken in blocks.
    """
    schema = f"qid {dict(queries.dtypes)['qid']}, {key} {dict(index.dtypes)[key]}, score double"
    rows = index.select(F.col(key).alias("k"), F.col(vector).alias("v"), "pq")
    out = queries.sparkSession.createDataFrame([], schema)
    for ids, q in dense.query_blocks(queries):
        held = index.sparkSession.sparkContext.broadcast((ids, q, model))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q, m = held.value
            t = m.tables(q)
            for pdf in batches:
                if not len(pdf):
                    continue
                codes = np.frombuffer(b"".join(pdf["pq"]), np.uint8).reshape(len(pdf), -1)
                rough = sum(t[:, p, :][:, codes[:, p]] for p in range(codes.shape[1]))
                some = min(RESCORED * k, len(pdf))
                best = np.argpartition(-rough, some - 1, axis=1)[:, :some]
                x, keys = _unit(pdf["v"]), pdf["k"].to_numpy()
                exact = np.einsum("qd,qsd->qs", q, x[best])
                take = min(k, some)
                order = np.lexsort((keys[best], -np.round(exact, 6)), axis=1)[:, :take]
                yield pd.DataFrame({"qid": np.repeat(ids, take), key: keys[np.take_along_axis(best, order, 1)].ravel(), "score": np.take_along_axis(exact, order, 1).ravel()})

        out = out.unionByName(rows.mapInPandas(run, schema))
    return top_k(out, k, key=key)


def save(index: DataFrame, model: Codes, root: str) -> str:
    """Publishes an index as a version, with its model beside the rows."""
    spark = index.sparkSession
    version = catalog.publish(index, root)
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{root}/models/{version}")
    return version


def load(spark: SparkSession, root: str) -> tuple[DataFrame, Codes]:
    version = catalog.current_version(spark, root)
    return spark.read.parquet(f"{root}/{version}"), Codes.from_json(spark.read.parquet(f"{root}/models/{version}").first().model)


def append(new: DataFrame, root: str, key: str = "doc_id", vector: str = "embedding") -> int:
    """Codes new vectors with the model in place and adds them as files of the current version; returns how many.

    Keys that the index holds are not added again. A vector of another dimension is an error, as only a rebuild can take it.
    """
    spark = new.sparkSession
    rows, model = load(spark, root)
    if not new.where(F.col(vector).isNotNull() & (F.size(vector) != model.rotation.shape[0])).isEmpty():
        raise ValueError(f"the index holds vectors of dimension {model.rotation.shape[0]}")
    more = coded(catalog.not_yet(new, rows, key), model, vector).select(*rows.columns)
    before = rows.count()
    more.write.mode("append").parquet(f"{root}/{catalog.current_version(spark, root)}")
    return load(spark, root)[0].count() - before


def rebuild(spark: SparkSession, root: str, key: str = "doc_id", vector: str = "embedding") -> str:
    """Trains rotation and codes again on all that the index holds and publishes it as the next version; readers keep theirs until then."""
    rows, _ = load(spark, root)
    plain = rows.drop("pq")
    model = fit(plain, key, vector)
    return save(coded(plain, model, vector), model, root)
