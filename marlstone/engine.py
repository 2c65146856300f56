"""SQL text in, result envelopes out."""

from __future__ import annotations

import uuid
from dataclasses import asdict
from time import perf_counter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.catalog import Catalog, Field, Manifest, method_name
from marlstone.operators import relational
from marlstone.plans import syntax as S
from marlstone.sources.csv import inferred_columns
from marlstone.table import Table
from marlstone.types import spark_type

SCHEMA = "marlstone.v1"
DDL = {"create_table", "create_table_from_file", "create_index", "drop_table", "drop_index"}


class PlanError(ValueError):
    pass


class Unsupported(ValueError):
    pass


def plan(statements: list) -> list[dict[str, Any]]:
    """One plan per statement, but one per row of an INSERT; plain dicts with an action each."""
    out: list[dict[str, Any]] = []
    for s in statements:
        d = asdict(s) if not isinstance(s, S.Select) else {}
        match s:
            case S.CreateTable():
                keys = [c.name for c in s.columns if c.primary_key]
                if len(keys) > 1:
                    raise PlanError(f"table {s.table} has several primary keys")
                out.append({"action": "create_table", **d, "key": keys[0] if keys else s.columns[0].name})
            case S.CreateFromFile():
                out.append({"action": "create_table_from_file", **d})
            case S.CreateIndex():
                out.append({"action": "create_index", **d})
            case S.DropTable():
                out.append({"action": "drop_table", **d})
            case S.DropIndex():
                if s.table is None:
                    out.append({"action": "drop_index", **d, "by_name": True})
                else:
                    out.append({"action": "drop_index", **d})
            case S.Insert(path=str()):
                out.append({"action": "insert", "table": s.table, "from_file": s.path})
            case S.Insert():
                out += [{"action": "insert", "table": s.table, "columns": s.columns, "record": r} for r in s.rows]
            case S.Delete():
                out.append({"action": "remove", "table": s.table, "field": s.column, "op": s.op, "value": s.value})
            case S.Select():
                out.append({"action": _select_action(s.where), "table": s.table, "columns": s.columns, "where": s.where, "limit": s.limit})
    return out


def _select_action(where: Any) -> str:
    match where:
        case S.Compare(op="="):
            return "search"
        case S.Between():
            return "range_search"
        case S.Within():
            return "geo_within"
        case S.Knn():
            return "knn"
    return "select"


class Engine:
    """Runs scripts against a catalog. `frame` gives a SELECT as a lazy DataFrame, `run` gives envelopes.

    An envelope holds at most `most` rows of a SELECT. A longer result is written as Parquet to a folder that meta names
    as `path`; data then has its first rows.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 100_000):
        self.spark, self.catalog, self.most = spark, Catalog(spark, root), most

    def table(self, name: str) -> Table:
        return Table(self.catalog, name)

    def frame(self, sql: str) -> DataFrame:
        (s,) = S.parse(sql)
        if not isinstance(s, S.Select):
            raise Unsupported("only SELECT gives a frame")
        return self._select(plan([s])[0], Table(self.catalog, s.table))

    # ---- lowering ----

    def _condition(self, t: Table, df: DataFrame, e: Any) -> Column:
        known = {c.lower(): c for c in df.columns}

        def own(name: str) -> str:
            if name.lower() not in known:
                raise KeyError(f"{t.name} has no column {name}")
            return known[name.lower()]

        match e:
            case S.Logic(op="AND"):
                out = F.lit(True)
                for p in e.parts:
                    out &= self._condition(t, df, p)
                return out
            case S.Logic():
                out = F.lit(False)
                for p in e.parts:
                    out |= self._condition(t, df, p)
                return out
            case S.Compare():
                return relational.compare(df, own(e.column), e.op, e.value)
            case S.Between():
                return relational.between(df, own(e.column), e.low, e.high)
            case S.InList():
                return relational.in_list(df, own(e.column), e.values)
            case S.Within():
                from marlstone.functions.points import coordinates, distance2

                x, y = coordinates(df, own(e.column))
                return F.coalesce(distance2(x, y, *e.point) <= e.radius**2, F.lit(False))
            case S.Knn():
                raise Unsupported("KNN can't be combined with other conditions")
        raise Unsupported(f"condition {e!r}")

    def _select(self, p: dict[str, Any], t: Table) -> DataFrame:
        where, limit, columns = p["where"], p["limit"], p["columns"]
        m = t.manifest
        match where:
            case None:
                out = t.rows()
            case S.Knn():
                k = limit or where.k
                out = t.knn(where.column, where.target, where.value, k, where.indexed)
                return relational.project(out, columns, [m.column(where.column), *(["similarity"] if "similarity" in out.columns else [])])
            case S.Within():
                out = t.within_circle(where.column, where.point, where.radius)
            case S.Compare(op="="):
                out = t.search(where.column, where.value)
            case S.Between():
                out = t.range_search(where.column, where.low, where.high)
            case _:
                rows = t.rows()
                out = rows.where(self._condition(t, rows, where))
        out = relational.project(out, columns)
        return out if limit is None else out.limit(limit)

    # ---- statements ----

    def _create(self, p: dict[str, Any]) -> None:
        for c in p["columns"]:
            spark_type(c["type"])
        key = p["key"]
        own = next(c for c in p["columns"] if c["name"] == key)
        organisation = method_name(own["method"], "heap")
        if organisation not in ("heap", "sequential", "isam", "bplus"):
            raise PlanError(f"a primary key can't be organised as {organisation}")
        indexes = {c["name"]: method_name(c["index"], "bplus") for c in p["columns"] if c["index"]} | {c: method_name(x, "bplus") for c, x in p["indexes"]}
        m = Manifest(p["table"], [Field(c["name"], c["type"].upper(), c["length"]) for c in p["columns"]], key, organisation)
        m.indexes = {m.column(c): {"method": x, "name": f"{m.table}_{c}_{x}"} for c, x in indexes.items() if c.lower() != key.lower()}
        self.catalog.create(m)

    def _create_from_file(self, p: dict[str, Any], t: Table) -> int:
        if not self.catalog.exists(p["table"]):
            columns = inferred_columns(self.spark, p["path"])
            key = next((c for c, _ in columns if p["column"] and c.lower() == p["column"].lower()), columns[0][0])
            method = method_name(p["method"], "heap")
            primary = method if method in ("heap", "sequential", "isam", "bplus") else "heap"
            self.catalog.create(Manifest(p["table"], [Field(c, t) for c, t in columns], key, primary))
        n = t.import_csv(p["path"])
        if p["method"] and method_name(p["method"], "heap") not in ("heap", "sequential", "isam", "bplus"):
            self.table(p["table"]).create_index(p["column"], p["method"])
        return n

    def _drop_index(self, p: dict[str, Any]) -> None:
        if not p.get("by_name"):
            return self.table(p["table"]).drop_index(p["column"], p["name"])
        for t, d in self.catalog.tables().items():
            for c, x in d["indexes"].items():
                if x["name"].lower() == p["name"].lower():
                    return self.table(t).drop_index(c)
        raise KeyError(f"no index {p['name']}")

    def _one(self, p: dict[str, Any]) -> dict[str, Any]:
        t = Table(self.catalog, p.get("table") or "")
        match p["action"]:
            case "create_table":
                self._create(p)
                return _ok(p, message=f"Table {p['table']} is there.")
            case "create_table_from_file":
                n = self._create_from_file(p, t)
                return _ok(p, meta={"affected": n, "rejected": t.rejected, "io": {"read": 0, "write": t.written}}, message=f"{n} rows read.")
            case "create_index":
                t.create_index(p["column"], p["method"], p["name"])
                return _ok(p, message="Index is there.")
            case "drop_table":
                self.catalog.drop(p["table"])
                return _ok(p, message=f"Table {p['table']} is gone.")
            case "drop_index":
                self._drop_index(p)
                return _ok(p, message="Index is gone.")
            case "remove":
                n = t.remove(p["field"], p["op"], p["value"])
                return _ok(p, meta={"affected": n, "index_usage": t.usage, "io": {"read": 0, "write": t.written}}, message=f"{n} rows deleted.")
            case "insert":
                n = t.import_csv(p["from_file"])
                return _ok(p, meta={"affected": n, "rejected": t.rejected, "io": {"read": 0, "write": t.written}}, message=f"{n} rows read, {t.rejected} cells of another type set to null.")
        df = self._select(p, t)
        first = df.limit(self.most + 1)
        data = [_plain(r.asDict(recursive=True)) for r in first.collect()]  # bounded by `most`
        meta = {"index_usage": t.usage, "io": {"read": files_read(first), "write": 0}}
        if len(data) <= self.most:
            return _ok(p, data=data, meta=meta, message=f"{len(data)} rows found.")
        path = f"{self.catalog.root}/_results/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return _ok(p, data=data[: self.most], meta=meta | {"path": path}, message=f"More than {self.most} rows found, all of them at {path}.")

    def _insert_rows(self, plans: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """A run of single-row inserts into one table as one job, each with its own result."""
        t = self.table(plans[0]["table"])
        names = [f.name for f in t.manifest.fields]
        records, bad = [], {}
        for i, p in enumerate(plans):
            want = p["columns"] or names
            if len(p["record"]) != len(want):
                bad[i] = f"{len(p['record'])} values for {len(want)} columns"
            records.append(dict(zip(want, p["record"], strict=False)))
        good = [i for i in range(len(plans)) if i not in bad]
        try:
            done = dict(zip(good, t.insert([records[i] for i in good]), strict=True)) if good else {}
        except (ValueError, TypeError, KeyError):  # one of them can't be stored: find out which, row by row
            done = {}
            for i in good:
                try:
                    done[i] = t.insert([records[i]])[0]
                except (ValueError, TypeError, KeyError) as e:
                    bad[i] = str(e)
        key, written = t.manifest.key, t.written
        out = []
        for i, p in enumerate(plans):
            if i in bad:
                out.append(_failed(p, "EXEC_ERROR", bad[i]))
            elif not done[i]:
                value = next((v for c, v in records[i].items() if c.lower() == key.lower()), None)
                out.append(_failed(p, "DUPLICATE_KEY" if value is not None else "EXEC_ERROR", f"{key} = {value} is there already" if value is not None else f"{key} is missing"))
            else:
                out.append(_ok(p, meta={"affected": 1, "io": {"read": 0, "write": written}}, message="1 row inserted."))
                written = 0  # the rows of a run are written together; the first that went in counts the files
        return out

    def run(self, sql: str) -> dict[str, Any]:
        """The envelope of a script. A script that doesn't parse or plan does nothing; later errors stop their own statement only."""
        t0 = perf_counter()
        try:
            statements = S.parse(sql)
        except S.SqlSyntaxError as e:
            return _envelope([_failed({"action": "parse"}, "SYNTAX_ERROR", str(e), "parser", {"sql": sql})], parse=perf_counter() - t0)
        t1 = perf_counter()
        try:
            plans = plan(statements)
        except PlanError as e:
            return _envelope([_failed({"action": "plan"}, "PLAN_ERROR", str(e), "planner")], parse=t1 - t0, plan=perf_counter() - t1)
        t2 = perf_counter()
        results: list[dict[str, Any]] = []
        i = 0
        while i < len(plans):
            p, start, j = plans[i], perf_counter(), i + 1
            try:
                if p["action"] == "insert" and "record" in p:
                    while j < len(plans) and plans[j]["action"] == "insert" and plans[j]["table"] == p["table"] and "record" in plans[j]:
                        j += 1
                    new = self._insert_rows(plans[i:j])
                else:
                    new = [self._one(p)]
            except Unsupported as e:
                new = [_failed(p, "UNSUPPORTED_SELECT", str(e))]
            except PlanError as e:
                new = [_failed(p, "PLAN_ERROR", str(e), "planner")]
            except Exception as e:  # whatever a statement runs into is its result
                new = [_failed(x, "EXEC_ERROR", f"{type(e).__name__}: {str(e)[:500]}") for x in plans[i:j]]
            ms = (perf_counter() - start) * 1000 / len(new)
            for r in new:
                r["meta"]["time_ms"] = ms
            results += new
            i = j
        return _envelope(results, parse=t1 - t0, plan=t2 - t1, execute=perf_counter() - t2)

    def explain(self, sql: str) -> str:
        """The physical plan of a SELECT."""
        return self.frame(sql)._jdf.queryExecution().toString()


def files_read(df: DataFrame) -> int:
    """Files that the scans of a frame's plan have read, once it has run; from Spark's own metrics."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.metrics().contains("numFiles"):
            n += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def _plain(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v.hex() if isinstance(v, (bytes, bytearray)) else v


def _shown(p: dict[str, Any]) -> dict[str, Any]:
    where = p.get("where")
    return {k: (repr(where) if k == "where" and where is not None else v) for k, v in p.items()}


def _ok(p: dict[str, Any], data: list | None = None, meta: dict | None = None, message: str = "") -> dict[str, Any]:
    meta = {"io": {"read": 0, "write": 0}, "index_usage": []} | (meta or {})
    action = p["action"]
    return {"ok": True, "kind": "ddl" if action in DDL else "dml", "action": action, "table": p.get("table"), "count": len(data or []), "data": data or [], "meta": meta, "plan": _shown(p), "message": message}


def _failed(p: dict[str, Any], code: str, message: str, where: str = "executor", detail: dict | None = None) -> dict[str, Any]:
    action = p["action"]
    return {"ok": False, "kind": "ddl" if action in DDL else "dml", "action": action, "error": {"code": code, "message": message, "where": where, "detail": detail}, "count": 0, "data": [], "meta": {}, "plan": _shown(p)}


def _envelope(results: list[dict[str, Any]], parse: float = 0.0, plan: float = 0.0, execute: float = 0.0) -> dict[str, Any]:
    stats = {"parse_ms": parse * 1000, "plan_ms": plan * 1000, "exec_ms": execute * 1000, "time_ms": (parse + plan + execute) * 1000}
    return {"ok": all(r["ok"] for r in results), "schema": SCHEMA, "results": results, "warnings": [], "stats": stats}
