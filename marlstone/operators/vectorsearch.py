"""k nearest vectors by cosine: exhaustive, through candidates of an inverted index, and on sparse top-b weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import cosine_to, norm


def nearest_by_cosine(df: DataFrame, key: str, vector: str, query: list[float], k: int, newest_first: bool = False) -> DataFrame:
    """df's rows with similarity, best first. Ties by key, descending where newest_first. Vectors of another length never match."""
    out = df.withColumn("similarity", cosine_to(vector, query)).where(F.col("similarity").isNotNull())
    return out.orderBy(F.desc("similarity"), F.desc(key) if newest_first else F.asc(key)).limit(k)


def postings(df: DataFrame, key: str, vector: str, threshold: float = 0.0) -> DataFrame:
    """Rows word, doc, weight: components above the threshold. Sort by word when writing, so that scans prune."""
    each = df.select(df[key].alias("doc"), F.posexplode(df[vector]).alias("word", "weight"))
    return each.where(F.col("weight") > threshold).select("word", "doc", F.col("weight").cast("double").alias("weight"))


def candidates(lists: DataFrame, query: list[float]) -> DataFrame:
    """Distinct doc of vectors that have a listed component where the query has a positive one."""
    words = [i for i, x in enumerate(query) if x > 0]
    return lists.where(F.col("word").isin(words)).select("doc").distinct()


#: The share of vectors in one of the query's lists from which on a scan is cheaper than the lists.
DENSE = 0.1


def list_sizes(lists: DataFrame, total: int) -> dict[int, float]:
    """The share of the vectors that each list holds: a number for each dimension."""
    return {r["word"]: r["n"] / max(total, 1) for r in lists.groupBy("word").agg(F.count("*").alias("n")).collect()}


def is_candidate(vector: str, query: list[float], threshold: float = 0.0) -> Column:
    """The same as `candidates` decides, on the vector itself."""
    asked = ", ".join(str(x > 0).lower() for x in query)
    return F.expr(f"exists(zip_with(`{vector}`, array({asked}), (x, a) -> a AND x > double({threshold!r})), x -> coalesce(x, false))")


def nearest_by_index(df: DataFrame, lists: DataFrame, key: str, vector: str, query: list[float], k: int, shares: dict[int, float] | None = None) -> DataFrame:
    """Cosine over candidates only; ties by key, largest first.

    Lists prune where they are short. Where one of the query's lists holds a good part of all vectors (by `shares`, which an
    index knows), reading it and joining costs more than a look at each vector, so candidates are then found in the scan.
    """
    words = [i for i, x in enumerate(query) if x > 0]
    if shares is not None and max((shares.get(w, 0.0) for w in words), default=0.0) > DENSE:
        return nearest_by_cosine(df.where(is_candidate(vector, query)), key, vector, query, k, newest_first=True)
    found = candidates(lists, query).withColumnRenamed("doc", "_candidate")
    near = df.join(found, df[key] == found["_candidate"], "left_semi")
    return nearest_by_cosine(near, key, vector, query, k, newest_first=True)


def heaviest(lists: DataFrame, b: int = 4) -> DataFrame:
    """Per document its b largest weights, ties by word."""
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), "word")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= b).drop("rank")


def sparse_scores(sparse: DataFrame, full_norms: DataFrame, query: dict[int, float]) -> DataFrame:
    """Rows doc, similarity: the query against sparse weights, over its norm and the documents' full ones; zero scores are left out."""
    size = sum(x * x for x in query.values()) ** 0.5
    used = {w: x for w, x in query.items() if x}
    if not size or not used:
        return sparse.where("false").select("doc", F.lit(0.0).alias("similarity"))
    asked = F.create_map(*(F.lit(v) for w, x in sorted(used.items()) for v in (int(w), float(x))))
    hits = sparse.where(F.col("word").isin(list(used))).groupBy("doc").agg(F.sum(F.col("weight") * asked[F.col("word")]).alias("s"))
    out = hits.join(full_norms, "doc").where("norm > 0").select("doc", (F.col("s") / (F.col("norm") * F.lit(size))).alias("similarity"))
    return out.where("similarity <> 0")


def full_norms(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(df[key].alias("doc"), norm(df[vector]).alias("norm"))


# ---- quantisation ----


def nearest_centroid(vector: Column, centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid, the first among equals."""
    away = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, c))), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) for c in centroids]
    d = F.array(*away)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def codeword_histograms(assigned: DataFrame, key: str, word: str) -> DataFrame:
    """Rows key, word, share: how a key's frames spread over codewords; shares of a key add up to 1."""
    counts = assigned.groupBy(key, word).agg(F.count("*").alias("n"))
    return counts.select(key, word, (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def smooth_tfidf(histograms: DataFrame, key: str, word: str, share: str, documents: DataFrame) -> DataFrame:
    """Rows key, word, weight: share * (ln((1+N)/(1+df)) + 1), rows normed to length 1. documents: one row n."""
    from marlstone.functions.text import smooth_idf

    df = histograms.where(F.col(share) > 0).groupBy(word).agg(F.count("*").alias("df"))
    w = histograms.join(df, word).crossJoin(F.broadcast(documents)).withColumn("w", F.col(share) * smooth_idf(F.col("n"), F.col("df")))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, word, (F.col("w") / size).alias("weight"))


# Named settings of codebooks.
CODEBOOKS = {"demo": {"k": 400, "sample": 100_000, "max_iterations": 150}, "production": {"k": 500, "sample": None, "max_iterations": 300}}


def train_codebook(frames: DataFrame, vector: str, k: int, max_iterations: int = 150, tolerance: float = 1e-4, seed: int = 42, sample: int | None = None):
    """A KMeansModel; its summary has the inertia (trainingCost). sample: about how many frames to train on, drawn by hash; None for all.

    train_codebook(frames, "v", **CODEBOOKS["demo"]) for a named setting.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = frames.select(array_to_vector(frames[vector].cast("array<double>")).alias("_features"), frames[vector].alias("_raw"))
    if sample is not None and (n := rows.count()) > sample:
        rows = rows.where(F.pmod(F.xxhash64("_raw", F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    return KMeans(k=k, seed=seed, maxIter=max_iterations, tol=tolerance, featuresCol="_features", predictionCol="codeword").fit(rows.select("_features"))


def quantise(frames: DataFrame, vector: str, model) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.transform(frames.select("*", array_to_vector(frames[vector].cast("array<double>")).alias("_features"))).drop("_features")
