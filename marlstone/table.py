"""One table: reading, inserting, deleting, importing, and its indexes."""

from __future__ import annotations

import contextlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.catalog import CONTENT, PRIMARY, Catalog, Manifest, method_name
from marlstone.functions.media import path_vector, path_vectors
from marlstone.functions.text import has_text
from marlstone.functions.vectors import parse_vector
from marlstone.operators import relational, spatial, vectorsearch
from marlstone.operators.textsearch import TextIndex, index_statistics, knn_text, store_frequencies
from marlstone.sources.csv import count_rejected, read_csv


#: Segments below SMALL bytes, of which MERGED become one; most bytes of a row group of a secondary index.
SMALL, MERGED, GROUP = 64 << 20, 16, 4 << 20
#: Readers of stored indexes that are kept open.
OPENED = 32


class Table:
    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name, self.spark = catalog, name, catalog.spark
        self.usage: list[dict] = []  # which index a query used, for the envelope
        self.written = 0  # files written, for the envelope
        self.rejected = 0  # cells of the last import that can't be read as their column's type

    @property
    def manifest(self) -> Manifest:
        return self.catalog.load(self.name)

    def rows(self) -> DataFrame:
        return self.catalog.read(self.manifest)

    # ---- writing ----

    def _segment(self, m: Manifest, rows: DataFrame) -> str:
        path = self.catalog.write_segment(m, rows)
        self.written += sum(n.endswith(".parquet") for n in self.catalog.store.names(path))
        return path

    def _append(self, m: Manifest, number: int, rows: DataFrame) -> None:
        m.segments.append(self._segment(m, rows))
        m.data_version += 1
        self._merge_small(m)
        self.catalog.save(m, number)

    def _merge_small(self, m: Manifest) -> None:
        """Make one segment of the small ones when there are MERGED of them, as single inserts leave one each."""
        if len(m.segments) < MERGED:
            return
        small = [s for s in m.segments if self.catalog.store.size(s) < SMALL]
        if len(small) >= MERGED:
            rows = self.spark.read.schema(m.schema).parquet(*small)
            m.segments = [s for s in m.segments if s not in small] + [self._segment(m, rows)]

    def insert(self, records: list[dict[str, Any]]) -> list[bool]:
        """Insert rows, the first of each new key; for each record whether it went in. One look-up and one write for all."""
        m, number = self.catalog.change(self.name)
        kinds = {f.name: f.dataType for f in m.schema}
        clean = [{c: _coerced(r.get(c), t) for c, t in kinds.items()} for r in ({m.column(c): v for c, v in r.items()} for r in records)]
        keys = [r[m.key] for r in clean]
        base = self.catalog.read(m)
        wanted = list({k for k in keys if k is not None})
        present = {r[0] for r in base.where(F.col(m.key).isin(wanted)).select(m.key).collect()} if wanted else set()  # bounded by the statement
        done, ok = set(present), []
        for k in keys:
            ok.append(k is not None and k not in done)
            done.add(k)
        if any(ok):
            new = [tuple(r[c] for c in kinds) for r, good in zip(clean, ok, strict=True) if good]
            self._append(m, number, self.spark.createDataFrame(new, m.schema))
        return ok

    def build(self, rows: DataFrame) -> int:
        """Append rows of a frame whose keys are new, the first of each key in the frame's order; returns the rows given."""
        from pyspark.sql import Observation

        m, number = self.catalog.change(self.name)
        seen = Observation()
        numbered = rows.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("_at", F.monotonically_increasing_id()).where(F.col(m.key).isNotNull())
        fresh = relational.first_per_key(numbered, m.key, F.col("_at")).drop("_at")
        self._append(m, number, relational.new_keys(fresh, self.catalog.read(m), m.key) if m.segments else fresh)
        return seen.get["n"]

    def import_csv(self, path: str) -> int:
        """Append a CSV file; returns the rows read. Rows whose key is null or there already are left out.

        Cells that can't be read as their column's type are null; `rejected` then says how many.
        """
        schema = self.manifest.schema
        self.rejected = count_rejected(self.spark, path, schema)
        return self.build(read_csv(self.spark, path, schema))

    def remove(self, column: str, op: str, value: Any) -> int:
        """Delete matching rows; only segments with any are rewritten."""
        m, number = self.catalog.change(self.name)
        column = m.column(column)
        base = self.catalog.read(m)
        hit = relational.compare(base, column, op, value)
        touched = {r["f"]: r["n"] for r in base.where(hit).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()}
        if not touched:
            return 0
        kept = []
        for s in m.segments:
            if not any(f.endswith(s.split(":", 1)[-1].lstrip("/")) for f in touched):
                kept.append(s)
                continue
            part = self.spark.read.schema(m.schema).parquet(s)
            rest = part.where(~F.coalesce(relational.compare(part, column, op, value), F.lit(False)))
            kept.append(self._segment(m, rest))
        m.segments = kept
        m.data_version += 1
        self.catalog.save(m, number)
        return sum(touched.values())

    def reorganise(self, organisation: str) -> None:
        """All rows as one segment in the layout of `organisation`; the rows stay the same."""
        m, number = self.catalog.change(self.name)
        rows = self.catalog.read(m)
        m.organisation = organisation
        if m.segments:
            m.segments = [self._segment(m, rows)]
            m.data_version += 1
        self.catalog.save(m, number)

    # ---- indexes ----

    def create_index(self, column: str, method: str | None = None, name: str | None = None) -> None:
        m, number = self.catalog.change(self.name)
        column, method = m.column(column), method_name(method, "bplus")
        if column == m.key and method in PRIMARY:
            if method != m.organisation:
                self.reorganise(method)
            return
        if column in m.indexes:
            return
        m.indexes[column] = {"method": method, "name": name or f"{m.table}_{column}_{method}"}
        if method in CONTENT:
            self._refresh(m, column)
        else:
            self._cover(m, column)
        self.catalog.save(m, number)

    def drop_index(self, column: str | None = None, name: str | None = None) -> None:
        m, number = self.catalog.change(self.name)
        if column is None:
            found = [c for c, x in m.indexes.items() if x["name"].lower() == str(name).lower()] or [c for c in m.indexes if c.lower() == str(name).lower()]
            if not found:
                raise KeyError(f"{m.table} has no index {name}")
            column = found[0]
        column = m.column(column)
        if column == m.key and column not in m.indexes:
            return self.reorganise("heap")
        if column not in m.indexes:
            raise KeyError(f"{m.table} has no index on {column}")
        gone = m.indexes.pop(column)
        self.catalog.save(m, number)
        for path in [gone.get("path"), *(p if isinstance(p, str) else p["tf"] for p in gone.get("parts", {}).values())]:
            if path:
                self.catalog.store.delete(path)

    def _parts(self, m: Manifest, column: str, make) -> bool:
        """Bring an index's parts, one for each segment, in line with the table's segments; whether anything changed."""
        parts = m.indexes[column].setdefault("parts", {})
        gone, new = [s for s in parts if s not in m.segments], [s for s in m.segments if s not in parts]
        for s in gone:
            del parts[s]  # the files stay for readers of older manifests, as those of segments do
        for s in new:
            parts[s] = make(self.spark.read.schema(m.schema).parquet(s))
        return bool(gone or new)

    def _cover(self, m: Manifest, column: str) -> bool:
        """A secondary index: of each segment a copy in the order of the column, whose footers then prune what is asked for.

        bplus sorts by the value. hash spreads rows by it and adds Bloom filters, for equality. rtree sorts points along a
        Z-order curve and keeps both coordinates as columns, so windows prune.
        """
        method = m.indexes[column]["method"]

        def make(rows: DataFrame) -> str:
            path = self.catalog.new_folder(m.table, "indexes")
            if method == "rtree":
                rows = spatial.in_z_order(rows, column)
            elif method == "hash":
                rows = rows.repartition(F.col(f"`{column}`")).sortWithinPartitions(f"`{column}`")
            else:
                rows = rows.repartitionByRange(F.col(f"`{column}`")).sortWithinPartitions(f"`{column}`")
            out = rows.write.option("parquet.block.size", GROUP)
            if method == "hash":
                out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
            out.parquet(path)
            return path

        return self._parts(m, column, make)

    def _through(self, column: str, op: str, methods: tuple[str, ...]) -> DataFrame:
        """The table's rows, read through a secondary index on the column if there is one of such a method; noted in `usage`."""
        m, number = self.catalog.change(self.name)
        method = m.indexes.get(column, {}).get("method")
        if column == m.key:
            self.usage.append({"where": "primary", "index": m.organisation, "field": column, "op": op})
        if method not in methods:
            return self.catalog.read(m)
        if self._cover(m, column):
            self.catalog.save(m, number)
        self.usage.append({"where": "secondary", "index": method, "field": column, "op": op})
        parts = list(m.indexes[column]["parts"].values())
        if not parts:
            return self.catalog.read(m)
        schema = spatial.with_place(m.schema) if method == "rtree" else m.schema
        return self.spark.read.schema(schema).parquet(*parts)

    def _refresh(self, m: Manifest, column: str) -> None:
        """Write a content index for the table's present rows and note for which state of the data it is."""
        index = m.indexes[column]
        path = self.catalog.new_folder(m.table, "indexes")
        base = self.catalog.read(m)
        if index["method"] == "invtext":
            if base.where(has_text(F.col(column))).isEmpty():
                raise ValueError(f"{m.table}.{column} has no text to index")

            def make(rows: DataFrame) -> dict:
                part = self.catalog.new_folder(m.table, "indexes")
                return {"tf": part, "n": store_frequencies(rows, m.key, column, part)}

            self._parts(m, column, make)  # only new segments are tokenised
            parts = index["parts"].values()
            TextIndex.finish(self.spark.read.parquet(*(p["tf"] for p in parts)), sum(p["n"] for p in parts), path)
        else:
            vectors = self._image_histograms(base, m.key, column) if index["method"] == "bovw" else self._audio_vectors(base, m.key, column)
            vectors.write.parquet(f"{path}/vectors")
            stored = self.spark.read.parquet(f"{path}/vectors")
            if index["method"] == "bovw":
                if stored.isEmpty():
                    raise ValueError(f"{m.table}.{column} has no picture that can be read")
                self._bovw(stored, path)
            else:
                vectorsearch.postings(stored, "doc", "vector").repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/postings")
        old = index.get("path")
        index |= {"path": path, "version": m.data_version}
        if old:
            self.catalog.store.delete(old)

    def _fresh(self, column: str, method: str) -> str:
        """The path of a content index, rebuilt first if the data have changed since."""
        m, number = self.catalog.change(self.name)
        index = m.indexes.get(column)
        if index is None or index["method"] != method:
            raise KeyError(f"{m.table}.{column} has no {method} index; use <--> to search without one")
        if index.get("version") != m.data_version:
            self._refresh(m, column)
            self.catalog.save(m, number)
        self.usage.append({"where": "secondary", "index": method, "field": column, "op": "knn"})
        return index["path"]

    def index_statistics(self, column: str) -> DataFrame:
        index = self.manifest.indexes[self.manifest.column(column)]
        by = "term" if index["method"] == "invtext" else "word"
        return index_statistics(self.spark.read.parquet(f"{self._fresh(column, index['method'])}/postings"), by)

    def check_index(self, column: str) -> list[str]:
        """What is missing or doesn't add up in an index's files; nothing if it is whole."""
        m = self.manifest
        index, store = m.indexes[m.column(column)], self.catalog.store
        parts = {s: p if isinstance(p, str) else p["tf"] for s, p in index.get("parts", {}).items()}
        wrong = [f"{p} is missing" for p in parts.values() if not store.exists(f"{p}/_SUCCESS")]
        if index["method"] not in CONTENT:
            return wrong + [f"{s} isn't covered" for s in m.segments if s not in parts]
        needed = {"invtext": ("idf", "norms", "postings"), "bovw": ("vectors", "idf", "norms", "postings"), "audio": ("vectors", "postings")}[index["method"]]
        wrong += [f"{index['path']}/{n} is missing" for n in needed if not store.exists(f"{index['path']}/{n}/_SUCCESS")]
        if not wrong and index["method"] == "invtext":
            read = lambda n: self.spark.read.parquet(f"{index['path']}/{n}")
            lists = read("idf").agg(F.count("*").alias("lists"), F.sum("df").alias("postings")).first()
            stored = read("postings").agg(F.count_distinct("term").alias("lists"), F.count("*").alias("postings")).first()
            if (lists["lists"], lists["postings"] or 0) != (stored["lists"], stored["postings"]):
                wrong.append(f"{stored['lists']} lists of {stored['postings']} postings, {lists['lists']} of {lists['postings']} expected")
        return wrong

    # ---- pictures and sounds ----

    def _image_histograms(self, base: DataFrame, key: str, column: str) -> DataFrame:
        """Rows doc, vector of the pictures that can be read.

        Folders are few, so their names come to the driver; files don't. One scan lists the folders' files, and only those that
        the table names are decoded.
        """
        from marlstone.functions.media import image_histogram

        path = F.regexp_replace(F.btrim(F.col(column)), "^file:/*", "/")
        named = base.where(F.length(F.btrim(F.col(column))) > 0).select(F.col(key).alias("doc"), path.alias("at"))
        folders = [r[0] for r in named.select(F.regexp_replace("at", "/[^/]*$", "")).distinct().collect()]
        folders = [f for f in folders if self.catalog.store.exists(f or "/")]
        if not folders:
            return self.spark.createDataFrame([], "doc string, vector array<double>")
        pictures = self.spark.read.format("image").option("dropInvalid", "true").load(folders)
        found = pictures.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("origin"), "image")
        found = found.join(named.select("at").distinct(), F.col("origin") == F.col("at"), "left_semi").select("origin", image_histogram(F.col("image")).alias("vector"))
        return named.join(found, named["at"] == found["origin"]).where(F.col("vector").isNotNull()).select("doc", "vector")

    def _bovw(self, stored: DataFrame, path: str) -> None:
        """Bin weights: term frequency times ln((N+1)/(df+1)), or the frequency alone where all of these are 0; four bins per picture."""
        bins = stored.select("doc", F.posexplode("vector").alias("word", "tf")).where("tf > 0")
        n = F.broadcast(stored.agg(F.count("*").alias("n")))
        idf = bins.groupBy("word").agg(F.count("*").alias("df")).crossJoin(n).select("word", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
        idf.write.parquet(f"{path}/idf")
        idf = self.spark.read.parquet(f"{path}/idf")
        zero = idf.where("idf <> 0").isEmpty()
        w = bins.join(F.broadcast(idf), "word").select("doc", "word", (F.col("tf") * (F.lit(1.0) if zero else F.col("idf"))).alias("weight"))
        w.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).write.parquet(f"{path}/norms")
        vectorsearch.heaviest(w).repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/postings")

    def _audio_vectors(self, base: DataFrame, key: str, column: str) -> DataFrame:
        made = path_vectors(F.col(column))
        own = next((c for c in base.columns if c.lower() == "tfidf_vector"), None)
        if own:
            kind = base.schema[own].dataType
            stored = base[own].cast("array<double>") if isinstance(kind, T.ArrayType) else parse_vector(base[own])
            made = F.coalesce(F.when(F.size(stored) > 0, stored), made)
        return base.where(F.col(column).isNotNull()).select(F.col(key).alias("doc"), made.alias("vector"))

    # ---- k nearest ----

    def _with_rows(self, hits: DataFrame, k: int, newest_first: bool = False) -> DataFrame:
        m = self.manifest
        base = self.catalog.read(m)
        order = F.desc(m.key) if newest_first else F.asc(m.key)
        return base.join(F.broadcast(hits), base[m.key] == hits["doc"]).drop("doc").orderBy(F.desc("similarity"), order).limit(k)

    def knn(self, column: str, target: str, value: Any, k: int, indexed: bool = True) -> DataFrame:
        m = self.manifest
        column = m.column(column)
        if target == "point":
            return spatial.nearest(self.rows(), column, *value, k, m.key).drop("distance")
        method = m.indexes.get(column, {}).get("method")
        if target == "image":
            return self._knn_image(column, value, k, indexed)
        if target in ("audio", "vector") or method == "audio":
            query = json.loads(value) if target == "vector" else path_vector(value)
            return self._knn_audio(column, [float(x) for x in query], k, indexed)
        return self._knn_text(column, str(value), k, indexed)

    def _knn_text(self, column: str, query: str, k: int, indexed: bool) -> DataFrame:
        m = self.manifest
        index = self._opened(self._fresh(column, "invtext"), lambda path: TextIndex.read(self.spark, path)) if indexed else TextIndex.build(self.rows(), m.key, column)
        return knn_text(self.rows(), index, query, k, m.key)

    def _opened(self, path: str, read):
        """What `read` makes of a stored index, kept for the next query; the oldest go beyond OPENED."""
        opened = self.catalog.opened
        if path not in opened:
            while len(opened) >= OPENED:
                opened.pop(next(iter(opened)))
            opened[path] = read(path)
        return opened[path]

    def _knn_audio(self, column: str, query: list[float], k: int, indexed: bool) -> DataFrame:
        m = self.manifest
        if not indexed:
            stored = self._audio_vectors(self.rows(), m.key, column)
            hits = vectorsearch.nearest_by_cosine(stored, "doc", "vector", query, k, newest_first=True)
        else:
            path = self._fresh(column, "audio")
            stored, lists = self.spark.read.parquet(f"{path}/vectors"), self.spark.read.parquet(f"{path}/postings")
            shares = self._opened(f"{path}/shares", lambda _: vectorsearch.list_sizes(lists, stored.count()))
            hits = vectorsearch.nearest_by_index(stored, lists, "doc", "vector", query, k, shares)
        return self._with_rows(hits.select("doc", "similarity"), k, newest_first=True)

    def _knn_image(self, column: str, path: str, k: int, indexed: bool) -> DataFrame:
        """Indexed: four-bin weights against the full norm. Exhaustive: the weighted query against raw histograms. The two rank differently by design."""
        one = [r["vector"] for r in self._image_histograms(self.spark.createDataFrame([(0, path)], "doc int, p string"), "doc", "p").collect()]
        if not one:
            raise FileNotFoundError(f"{path} is no picture that can be read")
        index = self._fresh(column, "bovw")
        idf = {r["word"]: r["idf"] for r in self.spark.read.parquet(f"{index}/idf").collect()}  # at most 256
        weighted = [x * idf.get(i, 0.0) for i, x in enumerate(one[0])]
        query = weighted if any(weighted) else one[0]
        if indexed:
            hits = vectorsearch.sparse_scores(self.spark.read.parquet(f"{index}/postings"), self.spark.read.parquet(f"{index}/norms"), dict(enumerate(query))).orderBy(F.desc("similarity"), "doc").limit(k)
        else:
            hits = vectorsearch.nearest_by_cosine(self.spark.read.parquet(f"{index}/vectors"), "doc", "vector", query, k).where("similarity <> 0")
        return self._with_rows(hits.select("doc", "similarity"), k)

    # ---- one method per storage operation ----

    def search(self, column: str, value: Any) -> DataFrame:
        column = self.manifest.column(column)
        if self.manifest.indexes.get(column, {}).get("method") == "rtree" and (p := _point(value)):
            return self._place(spatial.at_point, column, "search", *p)
        rows = self._through(column, "search", ("bplus", "hash"))
        out = rows.where(relational.compare(rows, column, "=", value))
        return out.limit(1) if column == self.manifest.key else out

    def range_search(self, column: str, low: Any, high: Any) -> DataFrame:
        column = self.manifest.column(column)
        p, q = _point(low), _point(high)
        if self.manifest.indexes.get(column, {}).get("method") == "rtree" and p and q:
            return self._place(spatial.within_window, column, "range_search", *p, *q)
        rows = self._through(column, "range_search", ("bplus",))
        return rows.where(relational.between(rows, column, low, high))

    def _place(self, find, column: str, op: str, *args: float) -> DataFrame:
        rows = self._through(column, op, ("rtree",))
        return find(rows, column, *args).select(*self.manifest.schema.names)

    def within_circle(self, column: str, point: tuple[float, float], radius: float) -> DataFrame:
        return self._place(spatial.within_circle, self.manifest.column(column), "geo_within", *point, radius)

    def within_window(self, column: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        return self._place(spatial.within_window, self.manifest.column(column), "range_search", x0, y0, x1, y1)

    def text_search(self, column: str, query: str, k: int = 10) -> DataFrame:
        return self.knn(column, "text", query, k)

    def execute(self, request: dict[str, Any]) -> Any:
        """The storage interface as one call: {"op": ...}. Lists of dicts for rows; None for an unknown op.

        Rows come by key, those within a circle by distance and then key, nearest ones best first. They are fetched
        partition by partition.
        """
        op, column = request.get("op"), request.get("field") or request.get("column")
        listed = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]
        by_key = lambda df: listed(df.orderBy(self.manifest.key))
        match op:
            case "get_all":
                return by_key(self.rows())
            case "insert":
                return {"affected": int(self.insert([request["record"]])[0])}
            case "build":
                return {"count": sum(self.insert(request["records"]))}
            case "search":
                return by_key(self.search(column, request["value"]))
            case "range_search":
                return by_key(self.range_search(column, request["min"], request["max"]))
            case "remove":
                return {"affected": self.remove(column, "=", request["value"])}
            case "import_csv":
                return {"count": self.import_csv(request["path"])}
            case "rtree_within_circle":
                center = tuple(request["center"])
                found = self.within_circle(column, center, request["radius"])
                return listed(found.orderBy(spatial.distance_to(found, self.manifest.column(column), *center), self.manifest.key))
            case "rtree_range":
                return by_key(self.within_window(column, *request["window"]))
            case "create_inverted_text":
                return self.create_index(column, "invtext")
            case "drop_inverted_text":
                return self.drop_index(column)
            case "text_search":
                return listed(self.text_search(column, request.get("query_text") or request.get("consulta"), request.get("k", 10)))
            case "knn":
                for name, target in (("point", "point"), ("img_path", "image"), ("audio_path", "audio"), ("vector", "vector"), ("query_text", "text")):
                    if name in request:
                        value = json.dumps(request[name]) if target == "vector" and not isinstance(request[name], str) else request[name]
                        return listed(self.knn(column, target, value, request.get("k", 8), request.get("use_indexed", True)))
        return None


def _point(value: Any) -> tuple[float, float] | None:
    if isinstance(value, (list, tuple)) and len(value) == 2:
        return float(value[0]), float(value[1])
    with contextlib.suppress(ValueError, AttributeError):
        x, y = value.strip().strip("[]").split(",")
        return float(x), float(y)
    return None


def _coerced(value: Any, kind: T.DataType) -> Any:
    """A literal as a value of the column's type; ValueError if it can't be one."""
    if value is None or (isinstance(value, str) and value == "" and not isinstance(kind, T.StringType)):
        return None
    if isinstance(kind, T.BooleanType):
        return value.lower() in ("1", "true", "t", "yes", "y") if isinstance(value, str) else bool(value)
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(kind, T.FractionalType):
        return float(value)
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.ArrayType):
        return [float(x) for x in (json.loads(value) if isinstance(value, str) else value)]
    if isinstance(kind, T.BinaryType):
        return bytearray(value.encode() if isinstance(value, str) else value)
    return value


