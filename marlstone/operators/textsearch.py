"""TF-IDF text search: an index as three small tables, and top-k by cosine.

A posting holds a document's weight for a term already divided by the document's norm, so a query reads the rows of
its own terms, sums per document and takes the top k. Postings are written sorted by term: the parquet footers
then prune all row groups but those of the query's terms.

A stored index is made in two steps. Term frequencies are counted within each row, without a shuffle, and written once;
document frequencies, norms and postings come from these. When a table changes, only the rows of new segments are
tokenised, and the second step runs over the frequencies of all segments.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.functions.text import has_text, query_tokens, term_counts, text_idf


def term_frequencies(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows doc, term, tf; a row for each term of each row of docs, whose keys should be unique."""
    rows = docs.where(has_text(docs[column])).select(docs[key].alias("doc"), F.explode(term_counts(docs[column])).alias("x"))
    return rows.select("doc", "x.term", "x.tf")


def corpus_size(docs: DataFrame, column: str) -> DataFrame:
    """One row n: documents with text that isn't blank, whether it has tokens or not."""
    return docs.where(has_text(docs[column])).agg(F.count("*").alias("n"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idfs(df: DataFrame, n: DataFrame) -> DataFrame:
    """Rows term, df, idf; terms that every document has carry no weight and are left out."""
    return df.crossJoin(F.broadcast(n)).select("term", "df", text_idf(F.col("n"), F.col("df")).alias("idf")).where("idf > 0")


def norms(tf: DataFrame, idf: DataFrame) -> DataFrame:
    w = F.col("tf") * F.col("idf")
    return tf.join(idf, "term").groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def weighted(tf: DataFrame, idf: DataFrame, length: DataFrame) -> DataFrame:
    """Postings term, doc, tf, weight from term frequencies, idfs and norms."""
    return tf.join(idf.select("term", "idf"), "term").join(length, "doc").select("term", "doc", "tf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def spread(docs: DataFrame, key: str, column: str) -> DataFrame:
    """The two columns, dealt to more tasks where few files would leave cores without work; as they come otherwise."""
    narrow = docs.select(key, column)
    return narrow.repartition(key) if narrow.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism else narrow


def store_frequencies(docs: DataFrame, key: str, column: str, path: str) -> int:
    """Write docs' term frequencies to path; returns the corpus size, counted on the way."""
    docs, seen = spread(docs, key, column), Observation()
    term_frequencies(docs.where(has_text(docs[column])).observe(seen, F.count(F.lit(1)).alias("n")), key, column).write.parquet(path)
    return seen.get["n"]


def _broadcast_by_itself(df: DataFrame) -> bool:
    """Whether Spark broadcasts a stored table of this size."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


#: Terms whose idf a reader of a stored index keeps; it starts anew beyond.
KNOWN = 100_000


@dataclass
class TextIndex:
    """idf: term, df, idf. postings: term, doc, tf, weight (tf * idf / norm of the document)."""

    idf: DataFrame
    postings: DataFrame
    stored: bool = False  # whether reading a few rows of idf is cheap
    source: tuple[DataFrame, str, str] | None = None  # documents, key and column that it is made from
    known: dict[str, float] = field(default_factory=dict)  # idfs of terms asked for before, 0 for those that have none

    @staticmethod
    def build(docs: DataFrame, key: str, column: str) -> TextIndex:
        tf = term_frequencies(spread(docs, key, column), key, column)
        idf = idfs(document_frequencies(tf), corpus_size(docs, column))
        return TextIndex(idf, weighted(tf, idf, norms(tf, idf)), source=(docs, key, column))

    def write(self, path: str) -> None:
        """Write the index, step by step, so that texts are tokenised once."""
        docs, key, column = self.source
        n = store_frequencies(docs, key, column, f"{path}/tf")
        TextIndex.finish(docs.sparkSession.read.parquet(f"{path}/tf"), n, path)

    @staticmethod
    def finish(tf: DataFrame, n: int, path: str) -> None:
        """The second step, from stored term frequencies and the corpus size."""
        spark = tf.sparkSession
        df = document_frequencies(tf).select("term", "df", text_idf(F.lit(n), F.col("df")).alias("idf")).where("idf > 0")
        df.sortWithinPartitions("term").write.parquet(f"{path}/idf")
        idf = spark.read.parquet(f"{path}/idf")
        norms(tf, idf).write.parquet(f"{path}/norms")
        length = spark.read.parquet(f"{path}/norms")
        ranges = ("term", "doc")  # a term that very many documents have takes several ranges
        if _broadcast_by_itself(idf) and _broadcast_by_itself(length):  # the joins keep the ranges, which are then drawn from the stored frequencies
            postings = weighted(tf.repartitionByRange(*ranges), idf, length)
        else:
            postings = weighted(tf, idf, length).repartitionByRange(*ranges)
        postings.sortWithinPartitions(*ranges).write.parquet(f"{path}/postings")

    @staticmethod
    def read(spark, path: str) -> TextIndex:
        return TextIndex(spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/postings"), True)

    def cached(self) -> TextIndex:
        return TextIndex(self.idf.cache(), self.postings.cache(), True)

    def _idfs(self, terms: list[str]) -> dict[str, float]:
        """The idfs of the terms that have one, by one small job for those not asked for before."""
        if new := [t for t in terms if t not in self.known]:
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = terms
            found = {r["term"]: r["idf"] for r in self.idf.where(F.col("term").isin(new)).select("term", "idf").collect()}
            self.known.update({t: found.get(t, 0.0) for t in new})
        return {t: self.known[t] for t in terms if self.known[t]}

    def scores(self, query: str) -> DataFrame:
        """Rows doc, similarity of all documents that share a weighted term with the query."""
        counts = Counter(query_tokens(query))
        if not counts:
            return self.postings.where("false").select("doc", F.lit(0.0).alias("similarity"))
        terms = sorted(counts)
        if self.stored:  # the weights of the query's terms, at most one row each, come to the driver: one small job instead of two broadcasts
            weight = {t: counts[t] * x for t, x in self._idfs(terms).items()}
            size = sum(x * x for x in weight.values()) ** 0.5
            if not weight:
                return self.postings.where("false").select("doc", F.lit(0.0).alias("similarity"))
            share = F.create_map(*(F.lit(x) for t, w in sorted(weight.items()) for x in (t, w / size)))
            hits = self.postings.where(F.col("term").isin(sorted(weight)))
            return hits.groupBy("doc").agg(F.sum(F.col("weight") * share[F.col("term")]).alias("similarity"))
        asked = F.create_map(*(F.lit(x) for t in terms for x in (t, float(counts[t]))))
        # a row per term of the query: bounded by what the user typed
        q = self.idf.where(F.col("term").isin(terms)).select("term", (asked[F.col("term")] * F.col("idf")).alias("wq"))
        q = F.broadcast(q)
        length = F.broadcast(q.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq")))
        hits = self.postings.where(F.col("term").isin(terms)).join(q, "term").groupBy("doc").agg(F.sum(F.col("wq") * F.col("weight")).alias("s"))
        return hits.crossJoin(length).select("doc", (F.col("s") / F.col("nq")).alias("similarity"))

    def top(self, query: str, k: int) -> DataFrame:
        return self.scores(query).orderBy(F.desc("similarity"), "doc").limit(k)


def knn_text(docs: DataFrame, index: TextIndex, query: str, k: int, key: str) -> DataFrame:
    """The rows of docs most similar to the query, with similarity; best first, ties by key."""
    hits = F.broadcast(index.top(query, k))  # k rows
    return docs.join(hits, docs[key] == hits["doc"]).drop("doc").orderBy(F.desc("similarity"), key)


def index_statistics(postings: DataFrame, by: str = "term") -> DataFrame:
    """One row: lists, postings, average and longest list."""
    sizes = postings.groupBy(by).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("lists"), F.sum("n").alias("postings"), F.avg("n").alias("avg_len"), F.max("n").alias("max_len"))
