"""Exact top-k retrieval: vectors in blocks of queries, and weighted character grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.lineage import cut

#: Characters of a part whose grams are counted at once, and of the texts scored at once; candidates a task holds beside the kept ones.
PART_CHARS, SCORED_CHARS, CANDIDATES = 1_500_000, 8192, 500_000
#: Query vectors sent out at once: bounds what is broadcast.
BLOCK, TFIDF_BLOCK = 4096, 4096
#: Odd numbers that hash a gram's characters.
_STEP, _LENGTH, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


class _Best:
    """The best rows of each query of a block, kept over a task's batches."""

    def __init__(self, queries: int, keep: int) -> None:
        self.keep = keep
        self.ids = np.empty((queries, 0), object)
        self.scores = np.empty((queries, 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of (queries, rows); ties go to the smaller id."""
        order = np.argsort(ids, kind="stable")
        all_ids = np.concatenate((self.ids, np.broadcast_to(ids[order].astype(object), scores.shape)), axis=1)
        all_scores = np.concatenate((self.scores, scores[:, order]), axis=1)
        if self.ids.shape[1]:  # kept rows may have larger ids than new ones
            place = np.argsort(all_ids, axis=1, kind="stable")
            all_ids, all_scores = (np.take_along_axis(x, place, axis=1) for x in (all_ids, all_scores))
        top = np.argsort(-all_scores, axis=1, kind="stable")[:, : self.keep]
        self.ids, self.scores = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_scores))

    def rows(self, queries: list) -> pd.DataFrame:
        line = np.repeat(np.arange(len(queries)), self.ids.shape[1])
        part = pd.DataFrame({"query_id": [queries[i] for i in line], "neighbour_id": self.ids.ravel(), "score": self.scores.ravel().astype(float)})
        return part[part["query_id"] != part["neighbour_id"]]


def cosine_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """``query_id, neighbour_id, score, place``: the k most similar other rows of each query.

    Queries go out in blocks of at most BLOCK; a task multiplies its rows with one block
    after the other in a single pass and keeps k candidates a query over all its batches,
    so what is shuffled is k rows a query and task.  Ties go to the smaller id; null
    vectors are left out; a row is not its own neighbour; ids are of any type.
    """
    sc = vectors.sparkSession.sparkContext
    clean = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    asked = ((r[0], r[1]) for r in queries.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).toLocalIterator())
    blocks = [sc.broadcast(([i for i, _ in b], _normal(np.asarray([v for _, v in b], np.float64)))) for b in iter(lambda: list(islice(asked, BLOCK)), [])]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [_Best(len(b.value[0]), k + 1) for b in blocks]
        for frame in frames:
            if len(frame):
                v = _normal(np.stack(frame["vec"].to_numpy()).astype(np.float64))
                for b, top in zip(blocks, kept, strict=True):
                    top.add(frame["id"].to_numpy(), np.round(b.value[1] @ v.T, 6))
        for b, top in zip(blocks, kept, strict=True):
            yield top.rows(b.value[0])

    id_type = clean.schema["id"].dataType.simpleString()
    out = clean.mapInPandas(best, f"query_id {id_type}, neighbour_id {id_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


class _GramBlock:
    """The unit vectors of some queries as postings by gram: only grams that a text shares cost a product."""

    def __init__(self, ids: list, grams: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.ids = ids
        query = np.repeat(np.arange(len(ids), dtype=np.int32), [len(g) for g in grams])
        every, weight = np.concatenate(grams), np.concatenate(weights)
        order = np.argsort(every, kind="stable")
        self.grams, self.begins = np.unique(every[order], return_index=True)
        self.counts = np.diff(np.append(self.begins, len(every)))
        self.query, self.weight = query[order], weight[order]

    def products(self, line: np.ndarray, grams: np.ndarray, weight: np.ndarray, lines: int) -> np.ndarray:
        """(lines, queries) of inner products with texts given as (line, gram, weight)."""
        size = lines * len(self.ids)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        on = np.flatnonzero(self.grams[at] == grams)
        n, begins = self.counts[at[on]], self.begins[at[on]]
        places = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        to = np.repeat(line[on] * len(self.ids), n) + self.query[places]
        return np.bincount(to, self.weight[places] * np.repeat(weight[on], n), size).reshape(lines, len(self.ids))


class _BestSharing:
    """The best texts of each query of a block among those that share a gram; a task holds a bounded number of candidates."""

    def __init__(self, block: _GramBlock, keep: int) -> None:
        self.block, self.keep = block, keep
        self.floor = np.zeros(len(block.ids))
        self.parts: list[pd.DataFrame] = []
        self.held = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of (texts, queries)."""
        at, query = np.nonzero((scores > 0) & (scores >= self.floor))
        if len(at):
            self.parts.append(pd.DataFrame({"query": query, "id": ids[at], "score": np.round(scores[at, query], 4)}))
            self.held += len(at)
            if self.held > CANDIDATES + len(self.floor) * self.keep:
                self._settle()

    def _settle(self) -> pd.DataFrame:
        """Ties go to the smaller id."""
        best = pd.concat(self.parts, ignore_index=True).sort_values(["query", "score", "id"], ascending=[True, False, True], kind="stable")
        best = best.groupby("query", sort=False).head(self.keep)
        self.parts, self.held = [best], len(best)
        full = best.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.keep]
        self.floor[full.index] = full["min"] - 1e-4  # scores meet after rounding
        return best

    def rows(self) -> pd.DataFrame:
        best = self._settle() if self.parts else pd.DataFrame({"query": [], "id": [], "score": []})
        out = pd.DataFrame({"query_id": [self.block.ids[int(q)] for q in best["query"]], "neighbour_id": best["id"].to_numpy(), "score": best["score"].to_numpy(float)})
        return out[out["query_id"] != out["neighbour_id"]]


def _text_grams(texts: list[str], line: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, gram, tf), sorted by line: counts of the character grams of all texts of each line; a gram is its 64-bit hash."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    hashed, of = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, high + 1):
        code = code[: len(points) - n + 1] * _STEP + points[n - 1 :] + np.uint64(1) if len(points) >= n else code[:0]
        if n >= low:
            inside = np.flatnonzero(owner[: len(code)] == owner[n - 1 :]) if len(code) else np.zeros(0, np.int64)
            x = code[inside] + np.uint64(n) * _LENGTH
            x = (x ^ (x >> np.uint64(31))) * _MIX
            hashed.append(x ^ (x >> np.uint64(29)))
            of.append(line[owner[inside]])
    grams, number = np.unique(np.concatenate(hashed), return_inverse=True)
    keys, tf = np.unique(np.concatenate(of) * max(len(grams), 1) + number, return_counts=True)
    return keys // max(len(grams), 1), grams[keys % max(len(grams), 1)], tf


def _lines(texts: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The different ids, null among them, and each row's place in them."""
    coded = texts["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def tfidf_top_k(texts: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, low: int = 3, high: int = 5) -> DataFrame:
    """Smooth tf-idf over character grams, unit length, inner product, best k other rows of each query that share a gram.

    The texts are spread over parts of about PART_CHARS characters.  A part counts its
    grams by itself; what is shuffled is each different gram of a part, to be summed, and
    its document frequency back to the parts that have it, so no table of grams is held
    in one place.  Each text then keeps its norm, and a query its vector.  The queries, a
    stated subset of the texts, go out in blocks of at most TFIDF_BLOCK as postings by
    gram, two arrays a query in the driver; a task adds up the postings of its texts, a
    few at a time, and keeps k candidates a query.  Rows with the same id are one text;
    null texts are left out, a null id counts for the frequencies only.
    """
    spark = texts.sparkSession
    clean = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("t"))
    n_all, chars = clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    id_type = clean.schema["id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("id"), F.lit(max(chars // PART_CHARS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    asked = queries.select(F.col(id_col).alias("id")).distinct().withColumn("asked", F.lit(True))
    parted = clean.join(asked, "id", "left").withColumn("part", part)

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, line = _lines(rows)
        _, grams, _ = _text_grams(rows["t"].to_pylist(), line, low, high)
        different, n = np.unique(grams, return_counts=True)
        return pa.table({"part": pa.array(np.full(len(n), key[0].as_py())), "gram": different.view(np.int64), "n": n.astype(np.int64)})

    def weigh(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, line = _lines(rows)
        of, grams, tf = _text_grams(rows["t"].to_pylist(), line, low, high)
        gram, df = known["gram"].to_numpy().view(np.uint64), known["df"].to_numpy()
        order = np.argsort(gram)
        idf = np.log((1.0 + n_all) / (1.0 + df[order])) + 1.0
        idf = idf[np.searchsorted(gram[order], grams)]
        norm = np.sqrt(np.bincount(of, (tf * idf) ** 2, len(ids)))
        texts_of: list[list[str]] = [[] for _ in range(len(ids))]
        for i, t in zip(line, rows["t"].to_pylist(), strict=True):
            texts_of[i].append(t)
        vectors: list[tuple[bytes, bytes] | tuple[None, None]] = [(None, None)] * len(ids)
        ends = np.searchsorted(of, np.arange(len(ids) + 1))
        for i in set(line[rows["asked"].is_valid().to_numpy()].tolist()):
            g = slice(ends[i], ends[i + 1])
            if norm[i] > 0:  # a text's grams carry their counts only: the square of the weight stands here
                vectors[i] = (grams[g].tobytes(), (tf[g] * idf[g] ** 2 / norm[i]).tobytes())
        out = pa.table({"id": ids, "texts": texts_of, "norm": norm, "grams": pa.array([g for g, _ in vectors], pa.binary()), "w": pa.array([w for _, w in vectors], pa.binary())})
        return out.filter(pc.and_(out["id"].is_valid(), pc.greater(out["norm"], 0)))

    counted = parted.groupBy("part").applyInArrow(count, "part bigint, gram bigint, n bigint")
    known = counted.groupBy("gram").agg(F.sum("n").alias("df"), F.collect_list("part").alias("parts")).select(F.explode("parts").alias("part"), "gram", "df")
    weighed = parted.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(weigh, f"id {id_type}, texts array<string>, norm double, grams binary, w binary")
    weighed = cut(weighed)
    rows = ((r.id, np.frombuffer(r.grams, np.uint64), np.frombuffer(r.w)) for r in weighed.where("grams is not null").select("id", "grams", "w").toLocalIterator())
    blocks = [spark.sparkContext.broadcast(_GramBlock(*map(list, zip(*b, strict=True)))) for b in iter(lambda: list(islice(rows, TFIDF_BLOCK)), [])]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [_BestSharing(b.value, k + 1) for b in blocks]
        for frame in frames:
            ids, norm = frame["id"].to_numpy(), frame["norm"].to_numpy()
            size = frame["texts"].map(lambda ts: sum(map(len, ts))).cumsum().to_numpy()
            for _, at in pd.Series(np.arange(len(ids))).groupby(size // SCORED_CHARS):
                a, z = at.iloc[0], at.iloc[-1] + 1
                own = frame["texts"].iloc[a:z]
                line, grams, tf = _text_grams([t for ts in own for t in ts], np.repeat(np.arange(z - a), own.map(len)), low, high)
                for top in kept:
                    top.add(ids[a:z], top.block.products(line, grams, tf / norm[a:z][line], z - a))
        for top in kept:
            yield top.rows()

    out = weighed.select("id", "texts", "norm").mapInPandas(best, f"query_id {id_type}, neighbour_id {id_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
