"""Registered queries of the engine's own operators, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.media import path_vectors
from marlstone.functions.points import box_area, box_enlargement, box_intersects, min_distance2
from marlstone.functions.vectors import cosine
from marlstone.operators import relational, spatial, textsearch, vectorsearch
from marlstone.plans import syntax as S

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- scans, projection, predicates: the dialect's own text, lowered over the given tables ----


class _View:
    """The engine's lowering over a Parquet table instead of a catalogued one."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name = df, name

    def rows(self) -> DataFrame:
        return self.df


def _lowered(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    from marlstone.engine import Engine

    (s,) = S.parse(sql)
    df = load(spark, sf_dir, s.table)
    out = df if s.where is None else df.where(Engine._condition(Engine.__new__(Engine), _View(df, s.table), df, s.where))
    out = relational.project(out, s.columns)
    return out if s.limit is None else out.limit(s.limit)


# name: (the dialect, SQL for the oracle or None where it is the same)
SELECTS = {
    "scan_all": ("SELECT * FROM nation", None),
    "project_cols": ("SELECT n_name, n_regionkey FROM nation", None),
    "eq_point": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7", None),
    "eq_string": ("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "eq_mixed_types": ("SELECT * FROM nation WHERE n_nationkey = 'x'", "SELECT * FROM nation WHERE FALSE"),
    "eq_null": ("SELECT * FROM nation WHERE n_nationkey = NULL", "SELECT * FROM nation WHERE FALSE"),
    "range_int": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 40", None),
    "range_float": ("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05", None),
    "range_string": ("SELECT p_partkey, p_name FROM part WHERE p_name BETWEEN 'b' AND 'm'", None),
    "in_list": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 42, 1000)", None),
    "in_list_strings": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'nothing')", None),
    "range_and_eq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag = 'R'", None),
    "eq_and_range": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity BETWEEN 1 AND 3", None),
    "or_parens": ("SELECT p_partkey, p_size FROM part WHERE (p_size < 3 OR p_size > 48) AND p_retailprice >= 905", None),
    "comparisons": ("SELECT p_partkey, p_size FROM part WHERE p_size <> 7 AND p_size <= 9 AND p_size > 2", None),
    "negative_literal": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -100.5", None),
    "bool_literal": ("SELECT n_name FROM nation WHERE n_nationkey >= 0 LIMIT 1000", "SELECT n_name FROM nation WHERE n_nationkey >= 0"),
}
for _name, (_sql, _oracle) in SELECTS.items():
    query(_name, _oracle or _sql)(partial(_lowered, sql=_sql))


@query("range_ts", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts <= (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def range_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    start = F.broadcast(e.agg(F.min("ts").alias("t0")))
    return e.crossJoin(start).where(F.col("ts").between(F.col("t0") + F.expr("INTERVAL 1 DAY"), F.col("t0") + F.expr("INTERVAL 3 DAY"))).select("event_id", "event_type")


@query("eq_float", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_discount AS REAL) = CAST(0.5 AS REAL) OR CAST(l_quantity AS REAL) = 7")
def eq_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("float").alias("d"), F.col("l_quantity").cast("float").alias("q"))
    return l.where((F.col("d") == F.lit(0.5)) | (F.col("q") == F.lit(7.0))).select("l_orderkey", "l_linenumber")


@query("limit_pk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def limit_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy("o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("random_access", "SELECT * FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_suppkey")
    s = load(spark, sf_dir, "supplier")
    return s.join(keys, s["s_suppkey"] == keys["l_suppkey"], "left_semi")


# ---- writes, as the rows that a table then has ----


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to insert into customer: present keys, new keys, and new keys twice."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("v"))
    old = c.where("k % 50 = 0").select("k", F.lit("again").alias("v"), F.lit(0).alias("at"))
    new = c.where("k % 50 = 1").select((F.col("k") + 10_000_000).alias("k"), "v", F.lit(1).alias("at"))
    twice = c.where("k % 100 = 1").select((F.col("k") + 10_000_000).alias("k"), F.lit("second").alias("v"), F.lit(2).alias("at"))
    return old.unionAll(new).unionAll(twice)


@query(
    "insert_dedup",
    """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS v FROM customer),
    n AS (SELECT k, 'again' AS v, 0 AS t FROM c WHERE k % 50 = 0 UNION ALL SELECT k + 10000000, v, 1 FROM c WHERE k % 50 = 1 UNION ALL SELECT k + 10000000, 'second', 2 FROM c WHERE k % 100 = 1)
    SELECT k, v FROM c UNION ALL SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS r FROM n) WHERE r = 1 AND k NOT IN (SELECT k FROM c)""",
)
def insert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("v"))
    fresh = relational.first_per_key(_batch(spark, sf_dir), "k", F.col("at")).select("k", "v")
    return base.unionByName(relational.new_keys(fresh, base, "k"))


@query("bulk_first_wins", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def bulk_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_per_key(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", F.col("l_linenumber"))


@query("delete_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def delete_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.where(~F.coalesce(relational.compare(o, "o_orderstatus", "=", "F"), F.lit(False))).select("o_orderkey", "o_orderstatus")


@query("reorganise_pk", "SELECT p_partkey, p_name, p_size FROM part")
def reorganise_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")


@query("null_key_filter", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def null_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(tx.has_text(F.col("text"))).select("doc_id")


# ---- points ----


def _points(spark: SparkSession, sf_dir: str, kind: str = "struct") -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    at = {"struct": F.struct("x", "y"), "json": F.concat(F.lit("["), x, F.lit(", "), y, F.lit("]")), "plain": F.concat(x, F.lit(","), y)}[kind]
    return p.select("p_partkey", at.alias("at"))


_P = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part)"
for _kind in ("struct", "json", "plain"):
    query(f"geo_within_{_kind}", f"SELECT p_partkey FROM {_P} WHERE (x - 25) * (x - 25) + (y - 1000) * (y - 1000) <= 2500")(lambda s, d, k=_kind: spatial.within_circle(_points(s, d, k), "at", 25, 1000, 50).select("p_partkey"))


@query("geo_window", f"SELECT p_partkey FROM {_P} WHERE x BETWEEN 5 AND 9 AND y BETWEEN 950 AND 1100")
def geo_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_window(_points(spark, sf_dir, "json"), "at", 5, 950, 9, 1100).select("p_partkey")


@query("geo_eq", f"SELECT a.p_partkey FROM {_P} a, (SELECT x, y FROM {_P} WHERE p_partkey = 10) b WHERE abs(a.x - b.x) <= 1e-9 AND abs(a.y - b.y) <= 1e-9")
def geo_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    one = p.where("p_partkey = 10").select("at.x", "at.y").first()
    return spatial.at_point(p, "at", one["x"], one["y"]).select("p_partkey") if one else p.where("false").select("p_partkey")


@query("geo_knn", f"SELECT p_partkey, round(sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), 6) AS distance FROM {_P} ORDER BY sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), p_partkey LIMIT 10")
def geo_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_points(spark, sf_dir, "plain"), "at", 25, 1000, 10, "p_partkey").select("p_partkey", F.round("distance", 6).alias("distance"))


_BOX = "(SELECT p_size AS g, min(CAST(p_partkey AS DOUBLE)) AS x0, min(CAST(p_retailprice AS DOUBLE)) AS y0, max(CAST(p_partkey AS DOUBLE)) AS x1, max(CAST(p_retailprice AS DOUBLE)) AS y1 FROM part GROUP BY p_size)"


@query(
    "geo_boxes",
    f"""SELECT a.g AS g, b.g AS h, round((a.x1 - a.x0) * (a.y1 - a.y0), 4) AS area,
    round((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) - (a.x1 - a.x0) * (a.y1 - a.y0), 4) AS enlargement,
    a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AS meets,
    round(power(greatest(a.x0 - 100, 0, 100 - a.x1), 2) + power(greatest(a.y0 - 5000, 0, 5000 - a.y1), 2), 4) AS away
    FROM {_BOX} a JOIN {_BOX} b ON b.g = a.g + 1""",
)
def geo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_partkey").cast("double"), F.col("p_retailprice").cast("double")
    box = F.struct(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
    a = load(spark, sf_dir, "part").groupBy(F.col("p_size").alias("g")).agg(box.alias("a"))
    b = a.select(F.col("g").alias("h"), F.col("a").alias("b"))
    j = a.join(b, F.col("h") == F.col("g") + 1)
    p, q = F.col("a"), F.col("b")
    return j.select("g", "h", F.round(box_area(p), 4).alias("area"), F.round(box_enlargement(p, q), 4).alias("enlargement"), box_intersects(p, q).alias("meets"), F.round(min_distance2(p, 100, 5000), 4).alias("away"))


@query("parse_point_formats", f"SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y FROM {_P}")
def parse_point_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.functions.points import coordinates

    even = _points(spark, sf_dir, "json").where("p_partkey % 2 = 0").unionByName(_points(spark, sf_dir, "plain").where("p_partkey % 2 = 1"))
    x, y = coordinates(even, "at")
    return even.select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# ---- text search ----

WORDS = "thing the éen"
_RX = tx.TOKEN
_TF = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_RX}')) AS term FROM documents WHERE length(trim(text)) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), n AS (SELECT count(*) AS n FROM documents WHERE length(trim(text)) > 0),
idf AS (SELECT term, count(*) AS df, log10((SELECT n FROM n) / count(*)) AS idf FROM tf GROUP BY term HAVING log10((SELECT n FROM n) / count(*)) > 0),
norms AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM tf JOIN idf USING (term) GROUP BY doc_id)"""


def _knn_sql(words: str, k: int) -> str:
    terms = sorted(set(tx.query_tokens(words)))
    q = " UNION ALL ".join(f"SELECT '{t}' AS term, {tx.query_tokens(words).count(t)} AS qtf" for t in terms)
    return f"""WITH {_TF}, q AS (SELECT term, qtf * idf AS wq, idf FROM ({q}) JOIN idf USING (term)),
    s AS (SELECT doc_id, sum(wq * tf * idf) / ((SELECT sqrt(sum(wq * wq)) FROM q) * any_value(norm)) AS sim FROM tf JOIN q USING (term) JOIN norms USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, round(sim, 6) AS similarity FROM s ORDER BY round(sim, 9) DESC, doc_id LIMIT {k}"""


def _text_index(spark: SparkSession, sf_dir: str) -> textsearch.TextIndex:
    return textsearch.TextIndex.build(load(spark, sf_dir, "documents"), "doc_id", "text")


def _top(index: textsearch.TextIndex, words: str, k: int) -> DataFrame:
    hits = index.scores(words).withColumn("r", F.round("similarity", 9)).orderBy(F.desc("r"), "doc").limit(k)
    return hits.select(F.col("doc").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


for _name, _words, _k in (("text_knn", WORDS, 8), ("text_match", "the and", 8), ("text_knn_seq", "des la thand", 20), ("text_knn_repeated_terms", "thing thing the", 5)):
    query(_name, _knn_sql(_words, _k))(lambda s, d, w=_words, k=_k: _top(_text_index(s, d), w, k))


@query("text_tokens", f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{_RX}')) AS BIGINT) AS n_tokens FROM documents")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("text_df_idf", f"WITH {_TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def text_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_index(spark, sf_dir).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query("text_postings", f"WITH {_TF} SELECT term, doc_id, tf FROM tf JOIN idf USING (term)")
def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_index(spark, sf_dir).postings.select("term", F.col("doc").alias("doc_id"), "tf")


@query("text_norms", f"WITH {_TF} SELECT doc_id, round(norm, 5) AS norm FROM norms")
def text_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    tf = textsearch.term_frequencies(d, "doc_id", "text")
    return textsearch.norms(tf, textsearch.idfs(textsearch.document_frequencies(tf), textsearch.corpus_size(d, "text"))).select(F.col("doc").alias("doc_id"), F.round("norm", 5).alias("norm"))


@query("index_stats", f"WITH {_TF}, l AS (SELECT term, count(*) AS n FROM tf JOIN idf USING (term) GROUP BY term) SELECT count(*) AS lists, CAST(sum(n) AS BIGINT) AS postings, round(avg(n), 6) AS avg_len, max(n) AS max_len FROM l")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.index_statistics(_text_index(spark, sf_dir).postings).select("lists", "postings", F.round("avg_len", 6).alias("avg_len"), "max_len")


# ---- vector search ----

_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_Q = "q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
_COS = "list_cosine_similarity(v, q)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _vector0(v: DataFrame) -> list[float]:
    return list(v.where("vec_id = 0").first()["v"])


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vec_knn_seq", f"WITH {_E}, {_Q} SELECT vec_id, round({_COS}, 6) AS similarity FROM e, q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vec_knn_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _rounded(vectorsearch.nearest_by_cosine(v, "vec_id", "v", _vector0(v), 10))


_SHARED = "len(list_filter(range(1, len(v) + 1), lambda i: v[i] > {t} AND q[i] > 0)) > 0"


@query("vec_knn_idx", f"WITH {_E}, {_Q} SELECT vec_id, round({_COS}, 6) AS similarity FROM e, q WHERE {_SHARED.format(t=0)} ORDER BY {_COS} DESC, vec_id DESC LIMIT 10")
def vec_knn_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _rounded(vectorsearch.nearest_by_index(v, vectorsearch.postings(v, "vec_id", "v"), "vec_id", "v", _vector0(v), 10))


@query("vec_candidates", f"WITH {_E}, {_Q} SELECT vec_id FROM e, q WHERE {_SHARED.format(t=0)}")
def vec_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectorsearch.candidates(vectorsearch.postings(v, "vec_id", "v"), _vector0(v)).withColumnRenamed("doc", "vec_id")


@query("vec_min_score", f"WITH {_E}, {_Q} SELECT vec_id FROM e, q WHERE {_SHARED.format(t=0.3)}")
def vec_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectorsearch.candidates(vectorsearch.postings(v, "vec_id", "v", 0.3), _vector0(v)).withColumnRenamed("doc", "vec_id")


_BINS = f"{_E}, p AS (SELECT vec_id, i - 1 AS word, v[i] AS w FROM e, unnest(range(1, 65)) AS u(i) WHERE v[i] > 0)"


@query("vec_topb_sparse", f"WITH {_BINS} SELECT vec_id, CAST(word AS INT) AS word, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, word) AS r FROM p) WHERE r <= 4")
def vec_topb_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = vectorsearch.postings(_vectors(spark, sf_dir), "vec_id", "v")
    return vectorsearch.heaviest(lists).select(F.col("doc").alias("vec_id"), "word", F.round("weight", 6).alias("weight"))


@query(
    "vec_sparse_knn",
    f"""WITH {_BINS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, word) AS r FROM p) WHERE r <= 4),
    q AS (SELECT word, w FROM p WHERE vec_id = 0), n AS (SELECT vec_id, sqrt(sum(w * w)) AS n FROM p GROUP BY vec_id),
    s AS (SELECT t.vec_id, sum(t.w * q.w) / (any_value(n.n) * (SELECT sqrt(sum(w * w)) FROM q)) AS s FROM t JOIN q ON t.word = q.word JOIN n ON t.vec_id = n.vec_id GROUP BY t.vec_id)
    SELECT vec_id, round(s, 6) AS similarity FROM s WHERE s <> 0 ORDER BY s DESC, vec_id LIMIT 10""",
)
def vec_sparse_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    lists = vectorsearch.postings(v, "vec_id", "v")
    norms = lists.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    asked = {i: x for i, x in enumerate(_vector0(v)) if x > 0}
    hits = vectorsearch.sparse_scores(vectorsearch.heaviest(lists), norms, asked).orderBy(F.desc("similarity"), "doc").limit(10)
    return hits.select(F.col("doc").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("vec_self_similarity", f"WITH {_E} SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS similarity FROM e")
def vec_self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(cosine(F.col("v"), F.reverse("v")), 6).alias("similarity"))


_H = "h AS (SELECT user_id, event_type AS word, count(*) AS c FROM events GROUP BY 1, 2), s AS (SELECT user_id, word, c / sum(c) OVER (PARTITION BY user_id) AS share FROM h), n AS (SELECT count(DISTINCT user_id) AS n FROM events), d AS (SELECT word, count(*) AS df FROM s GROUP BY word)"


@query("codeword_hist", f"WITH {_H} SELECT user_id, word, round(share, 6) AS share FROM s")
def codeword_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorsearch.codeword_histograms(load(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.col("event_type").alias("word"), F.round("share", 6).alias("share"))


@query("hist_tfidf_smooth", f"WITH {_H}, w AS (SELECT user_id, word, share * (ln((1 + n) / (1 + df)) + 1) AS w FROM s JOIN d USING (word), n) SELECT user_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 6) AS weight FROM w")
def hist_tfidf_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    h = vectorsearch.codeword_histograms(e, "user_id", "event_type").withColumnRenamed("event_type", "word")
    n = e.agg(F.countDistinct("user_id").alias("n"))
    return vectorsearch.smooth_tfidf(h, "user_id", "word", "share", n).select("user_id", "word", F.round("weight", 6).alias("weight"))


@query("hist_idf_ln1p", f"WITH {_H} SELECT word, df, round(ln((n + 1) / (df + 1)), 6) AS idf FROM d, n")
def hist_idf_ln1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    d = e.groupBy("user_id", "event_type").agg(F.count("*").alias("c")).groupBy(F.col("event_type").alias("word")).agg(F.count("*").alias("df"))
    return d.crossJoin(F.broadcast(e.agg(F.countDistinct("user_id").alias("n")))).select("word", "df", F.round(tx.image_idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(
    "codeword_assign",
    f"""WITH {_E}, c AS (SELECT label AS k, v AS c FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), o AS (SELECT c, row_number() OVER (ORDER BY k) - 1 AS i FROM c),
    d AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i) AS r FROM e, o)
    SELECT vec_id, CAST(i AS INT) AS codeword FROM d WHERE r = 1""",
)
def codeword_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min(F.struct("vec_id", "v")).alias("x")).orderBy("label").select("x.v").collect()  # a row per label
    return v.select("vec_id", vectorsearch.nearest_centroid(F.col("v"), [r["v"] for r in first]).alias("codeword"))


@query("centroid_means", f"WITH {_E}, p AS (SELECT label, i - 1 AS dim, v[i] AS x FROM e, unnest(range(1, 65)) AS u(i)) SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean FROM p GROUP BY label, dim")
def centroid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("dim", "x"))
    return p.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("topn_overlap", f"WITH {_E}, {_Q}, a AS (SELECT vec_id FROM e, q ORDER BY {_COS} DESC, vec_id LIMIT 5), b AS (SELECT vec_id FROM e, q WHERE {_SHARED.format(t=0)} ORDER BY {_COS} DESC, vec_id DESC LIMIT 5) SELECT count(*) AS shared FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def topn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    q = _vector0(v)
    a = vectorsearch.nearest_by_cosine(v, "vec_id", "v", q, 5).select("vec_id")
    b = vectorsearch.nearest_by_index(v, vectorsearch.postings(v, "vec_id", "v"), "vec_id", "v", q, 5).select("vec_id")
    return a.intersect(b).agg(F.count("*").alias("shared"))


# ---- statistics ----


@query("bench_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda c: F.round(c, 6)
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), v(F.avg("value")).alias("mean"), v(F.median("value")).alias("median"), v(F.percentile("value", 0.9)).alias("p90"), v(F.stddev_samp("value")).alias("std"))


@query("column_bounds", "SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, count(*) AS n FROM orders")
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"), F.count("*").alias("n"))


# ---- what SQL can't say: tested against brute force ----


@query("path_vector")
def path_vector_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", path_vectors(F.col("url")).alias("vector"))


@query("kmeans_inertia")
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    model = vectorsearch.train_codebook(v, "v", k=10)
    return vectorsearch.quantise(v, "v", model).groupBy("codeword").agg(F.count("*").alias("n")).withColumn("inertia", F.lit(model.summary.trainingCost))
