"""Quality rules with thresholds learnt from the corpus itself.

Fixed rules (too few words, too much repetition) come first. What passes them fills one quantile sketch per
language, source and feature: counts on a fixed grid with 32 steps per power of two, so a quantile is off by
1/32 of its value at most, two sketches merge by adding counts, and the result doesn't depend on the order of
merging. A fence lies beyond a quantile of the sketch by a multiple of that quantile's distance from the median,
which counts as one cell of the grid at least, as no sketch knows it better. Features that most documents have none
of (symbols, repeated lines and words) take quantiles far enough up to see who has some.

The fences of a group of n documents are weighted n to `prior` against those of the next larger one: language and
source against language, that against all. So a large source goes by its own documents and a small one by its
language's, without a number at which one gives way to the other. The fences, a row for each language and source,
are joined back and decide.

Everything is built-in expressions; a text is read once and only numbers are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.scratch import stash
from marlstone.llm.text import bucket, let, n_words, shifted, words

#: feature: (numerator, scale, denominator, per cent of the lower and of the upper quantile, how often its distance from the median)
FEATURES = {
    "word_len": ("word_chars", 100, "n_words", 20, 80, 6),
    "symbols": ("n_symbols", 10_000, "word_chars", None, 85, 1),
    "dup_lines": ("n_dup_lines", 10_000, "n_lines", None, 99, 1),
    "repeats": ("n_repeat_words", 10_000, "n_words", None, 99, 1),
}
#: Documents of its own that a group needs to weigh as much as the next larger one.
PRIOR = 200


def _repeat_words(h: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur twice or more; h: hashes of the words.

    Windows are compared by 64-bit hashes. Most texts repeat none, which one hash set shows; else windows are
    sorted with their places, and equal neighbours give the places of repeated windows.
    """

    def mix(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def covered(g: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def count(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return let(let(pairs, places), count)

    def windows(two: Column) -> Column:
        return let(mix(F.slice(two, F.lit(1), n - 3), shifted(two, 2, n - 3)), lambda four: mix(F.slice(four, F.lit(1), n - 4), shifted(h, 4, n - 4)))

    def decide(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0))

    two = mix(F.slice(h, F.lit(1), n - 1), shifted(h, 1, n - 1))
    return F.when(n < 6, F.lit(0)).otherwise(let(let(two, windows), decide))


def measures(text: Column) -> Column:
    """A struct of counts of a text: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

        def fields(x: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                let(F.transform(w, lambda y: F.xxhash64(y)), lambda h: _repeat_words(h, F.size(h))).cast("long").alias("n_repeat_words"),
            )

        return let(lines, fields)

    return let(words(text), of)


def base_failed(m: str = "_m") -> Column:
    n, r = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def _feature(name: str, m: str = "_m") -> Column:
    """A document's cell of the grid for a feature."""
    top, scale, bottom = FEATURES[name][:3]
    return bucket(F.floor(F.col(f"{m}.{top}") * scale / F.greatest(F.col(f"{m}.{bottom}"), F.lit(1))).cast("long"))


def _cell_width(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(v)) - 6, F.lit(0)))


def sketches(measured: DataFrame) -> DataFrame:
    """Rows (lang, source, feature, bucket, n): the sketches, merged by adding n; partial sums come before the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), _feature(k).alias("bucket")) for k in FEATURES)))
    rows = measured.where(~base_failed()).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), each.alias("x"))
    return rows.groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count("*").alias("n"))


def _group_fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group: t, its documents, and lo_ and hi_ for each feature, from its own sketch alone."""
    merged = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "feature")
    run = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("c"), F.sum("n").over(w).alias("t"))
    at = lambda q: F.min(F.when(F.col("c") * 100 >= F.col("t") * q, F.col("bucket")))
    levels = sorted({q for f in FEATURES.values() for q in (f[3], f[4], 50) if q is not None})
    found = run.groupBy(*by, "feature").agg(*(at(q).alias(f"q{q}") for q in levels), F.max("t").alias("t"))
    cols = []
    for f, (_, _, _, low, high, k) in FEATURES.items():
        mid, cell = F.col("q50"), _cell_width(F.col("q50"))
        mine = F.col("feature") == f
        cols.append(F.max(F.when(mine, F.col(f"q{high}") + k * F.greatest(F.col(f"q{high}") - mid, cell))).alias(f"hi_{f}"))
        cols.append(F.max(F.when(mine, F.lit(-1).cast("long") if low is None else F.col(f"q{low}") - k * F.greatest(mid - F.col(f"q{low}"), cell))).alias(f"lo_{f}"))
    return found.groupBy(*by).agg(*cols, F.max("t").alias("t"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """A row for each (lang, source) of the sketches with _lo_ and _hi_ for each feature."""
    out = sketch.select("lang", "source").distinct()
    for i, by in enumerate((["lang", "source"], ["lang"], [])):
        level = _group_fences(sketch, by)
        level = level.select(*(F.col(c).alias(f"{c}_{i}") for c in level.columns))
        on = [F.col(c).eqNullSafe(F.col(f"{c}_{i}")) for c in by]
        out = out.join(level, on, "left") if on else out.crossJoin(level)  # the last level has one row

    def weighed(c: str) -> Column:
        wide = (F.col("t_1") * F.col(f"{c}_1") + prior * F.col(f"{c}_2")) / (F.col("t_1") + prior)
        return (F.col("t_0") * F.col(f"{c}_0") + prior * wide) / (F.col("t_0") + prior)

    return out.select(F.col("lang").alias("_f_lang"), F.col("source").alias("_f_source"), *(weighed(f"{s}_{f}").alias(f"_{s}_{f}") for f in FEATURES for s in ("lo", "hi")))


def judge(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Add _failed and _kept to a materialised frame of _lang, _source and _m."""
    fence = stash(fences(stash(sketches(measured), "sketch"), prior), "fences")  # the files' sizes tell the join whether it may broadcast
    joined = measured.join(fence, F.col("_lang").eqNullSafe(F.col("_f_lang")) & F.col("_source").eqNullSafe(F.col("_f_source")), "left")
    inside = F.lit(True)
    for f in FEATURES:
        inside &= _feature(f).between(F.col(f"_lo_{f}"), F.col(f"_hi_{f}"))
    return joined.select(*measured.columns, base_failed().alias("_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("_kept"))


def _with_measures(docs: DataFrame, keep: list[str], text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(docs[c] for c in keep), docs[lang].alias("_lang"), docs[source].alias("_source"), measures(docs[text]).alias("_m"))


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per input row: key, the counts, base_failed and kept.

    Null or empty text has no words and fails. Null languages and sources form groups of their own. Repeated
    rows and keys are each judged. Other columns are ignored. No rows give no rows.
    """
    out = judge(stash(_with_measures(docs, [key], text, lang, source), "measures"), prior)
    return out.select(key, *(F.col(f"_m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """The rows whose text is kept, with all their columns; nulls and repeated rows as in quality_report."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # safe from names that clash with ours
    name = dict(zip(docs.columns, plain.columns, strict=True))
    out = judge(stash(_with_measures(plain, plain.columns, name[text], name[lang], name[source]), "measured"), prior)
    return out.where("_kept").select(*plain.columns).toDF(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    width = "(1 << greatest(length(bin(q50)) - 6, 0))"
    levels = sorted({q for f in FEATURES.values() for q in (f[3], f[4], 50) if q is not None})

    def level(i: int, by: list[str]) -> str:
        keys = "".join(f"{c}, " for c in by)
        part = ", ".join([*by, "feature"])
        mine = lambda f, x: f"max(CASE WHEN feature = '{f}' THEN {x} END)"
        cols = ", ".join(
            mine(f, f"q{high} + {k} * greatest(q{high} - q50, {width})") + f" AS hi_{f}, " + mine(f, "-1" if low is None else f"q{low} - {k} * greatest(q50 - q{low}, {width})") + f" AS lo_{f}"
            for f, (_, _, _, low, high, k) in FEATURES.items()
        )
        quantiles = ", ".join(f"min(CASE WHEN c * 100 >= t * {q} THEN bucket END) AS q{q}" for q in levels)
        return f"""
m{i} AS (SELECT {keys}feature, bucket, count(*) AS n FROM cells GROUP BY {keys}feature, bucket),
r{i} AS (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY {part}) AS t FROM m{i}),
q{i} AS (SELECT {keys}feature, {quantiles}, max(t) AS t FROM r{i} GROUP BY {keys}feature),
l{i} AS (SELECT {keys}{cols}, max(t)::DOUBLE AS t FROM q{i} {'GROUP BY ' + ', '.join(by) if by else ''})"""

    cell = lambda f: f"(f_{f} >> greatest(length(bin(f_{f})) - 6, 0)) << greatest(length(bin(f_{f})) - 6, 0)"
    feats = ", ".join(f"CAST(floor({x[0]} * {x[1]} / greatest({x[2]}, 1)) AS BIGINT) AS f_{f}" for f, x in FEATURES.items())
    cells = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {cell(f)} AS bucket FROM judged WHERE NOT base_failed" for f in FEATURES)
    fence = lambda c: f"(l0.t * l0.{c} + {PRIOR} * ((l1.t * l1.{c} + {PRIOR} * l2.{c}) / (l1.t + {PRIOR}))) / (l0.t + {PRIOR})"
    inside = " AND ".join(f"{cell(f)} BETWEEN {fence(f'lo_{f}')} AND {fence(f'hi_{f}')}" for f in FEATURES)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, unnest(range(0, 5)) AS u(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {feats} FROM m),
cells AS ({cells}),{level(0, ['lang', 'source'])},{level(1, ['lang'])},{level(2, [])}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, FALSE) AS kept
FROM judged j LEFT JOIN l0 ON j.lang IS NOT DISTINCT FROM l0.lang AND j.source IS NOT DISTINCT FROM l0.source LEFT JOIN l1 ON j.lang IS NOT DISTINCT FROM l1.lang LEFT JOIN l2 ON TRUE"""


ORACLE = _oracle()
