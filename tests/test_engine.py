"""Whole scripts through the engine, on small fixed tables."""

import struct
import zlib

import numpy as np
import pytest

from marlstone.engine import Engine

PRODUCTS = "(1,'Alpha',10.5,50),(2,'Bravo',20.0,15),(3,'Charlie',15.0,30),(4,'Delta',25.0,5),(5,'Echo',30.5,0)"
PLACES = [(1, "A", "[0.0, 0.0]"), (2, "B", "[1.0, 0.0]"), (3, "C", "0.0, 1.0"), (4, "D", "[1.0, 1.0]"), (5, "E", "[2.0, 2.0]"), (6, "F", "5.0,5.0"), (7, "G", "[-1.0, -1.0]")]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def run(engine, sql):
    return engine.run(sql)["results"]


def ids(engine, sql, column="id"):
    (r,) = run(engine, sql)
    assert r["ok"], r
    return [x[column] for x in r["data"]]


@pytest.mark.parametrize("organisation", ["heap", "sequential", "isam", "bplus"])
def test_products(engine, organisation):
    rs = run(engine, f"CREATE TABLE products (product_id INT PRIMARY KEY USING {organisation}, name VARCHAR(32), price FLOAT INDEX USING bplus, stock INT, INDEX(name) USING hash); INSERT INTO products VALUES {PRODUCTS}")
    assert [r["ok"] for r in rs] == [True] * 6
    p = lambda w: sorted(ids(engine, f"SELECT * FROM products WHERE {w}", "product_id"))
    assert p("product_id = 3") == [3]
    assert p("product_id BETWEEN 2 AND 4") == [2, 3, 4]
    assert p("name = 'Bravo'") == [2]
    assert p("price BETWEEN 10 AND 26") == [1, 2, 3, 4]
    assert p("price BETWEEN 10 AND 26 AND name = 'Delta'") == [4]
    assert p("name BETWEEN 'B' AND 'D'") == [2, 3]
    rs = run(engine, "INSERT INTO products VALUES (6,'Foxtrot',1,1), (3,'dup',1,1), (7,'x',1)")
    assert [r["ok"] for r in rs] == [True, False, False]
    assert [r["error"]["code"] for r in rs[1:]] == ["DUPLICATE_KEY", "EXEC_ERROR"]
    assert p("name = 'dup'") == []
    (r,) = run(engine, "DELETE FROM products WHERE product_id = 2")
    assert r["meta"]["affected"] == 1
    assert p("product_id = 2") == p("name = 'Bravo'") == []
    run(engine, "INSERT INTO products VALUES (2,'Bravo',20,15)")
    assert p("product_id = 2") == [2]
    assert len(ids(engine, "SELECT * FROM products", "product_id")) == 6
    assert len(ids(engine, "SELECT * FROM products LIMIT 2", "product_id")) == 2
    run(engine, "CREATE INDEX ON products(product_id) USING sequential")
    assert p("product_id BETWEEN 1 AND 100") == [1, 2, 3, 4, 5, 6]


def test_duplicates_in_one_statement(engine):
    rs = run(engine, "CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, 'first'), (1, 'second'), (NULL, 'none'); SELECT b FROM t")
    assert [r["ok"] for r in rs] == [True, True, False, False, True]
    assert rs[-1]["data"] == [{"b": "first"}]


def test_envelope(engine):
    e = engine.run("SELEC 1")
    assert not e["ok"]
    assert e["results"][0]["error"]["code"] == "SYNTAX_ERROR"
    assert engine.run("CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)")["results"][0]["error"]["code"] == "PLAN_ERROR"
    e = engine.run("CREATE TABLE t (a INT); SELECT * FROM nothing; SELECT zz FROM t; SELECT * FROM t WHERE a KNN (POINT(1,1), 2) AND a = 1")
    assert [r["ok"] for r in e["results"]] == [True, False, True, False]
    assert e["results"][1]["error"]["code"] == "EXEC_ERROR"
    assert e["results"][3]["error"]["code"] == "UNSUPPORTED_SELECT"
    assert {"parse_ms", "plan_ms", "exec_ms", "time_ms"} <= set(e["stats"])
    assert e["results"][0]["kind"] == "ddl"


def test_places(engine):
    values = ", ".join(f"({i}, '{n}', '{c}')" for i, n, c in PLACES)
    run(engine, f"CREATE TABLE places (id INT PRIMARY KEY, name VARCHAR(32), coords VARCHAR(64)); INSERT INTO places VALUES {values}")
    circle = "SELECT id FROM places WHERE coords IN (POINT(0.0, 0.0), 1.1)"
    assert sorted(ids(engine, circle)) == [1, 2, 3]
    run(engine, "CREATE INDEX ON places(coords) USING rtree; DELETE FROM places WHERE id = 2")
    assert sorted(ids(engine, circle)) == [1, 3]
    run(engine, "INSERT INTO places VALUES (2, 'B', '[1.0, 0.0]'), (9, 'bad', 'no point')")
    assert sorted(ids(engine, circle)) == [1, 2, 3]
    assert ids(engine, "SELECT id FROM places WHERE coords = '1,1'") == [4]
    assert sorted(ids(engine, "SELECT id FROM places WHERE coords BETWEEN '0,0' AND '1,1'")) == [1, 2, 3, 4]
    assert ids(engine, "SELECT id FROM places WHERE coords KNN (POINT(0, 0), 4)") == [1, 2, 3, 4]


def test_text(engine):
    rows = [(1, "playa mar arena verano"), (2, "nieve invierno montaña"), (3, "playa sol arena surf"), (4, "techno electronica rave"), (5, "playa atardecer costa"), (6, "  ")]
    run(engine, "CREATE TABLE m (id INT PRIMARY KEY, t TEXT); INSERT INTO m VALUES " + ", ".join(f"({i}, '{t}')" for i, t in rows))
    assert run(engine, "SELECT id FROM m WHERE t KNN <-> 'playa'")[0]["error"]["code"] == "EXEC_ERROR"
    run(engine, "CREATE INDEX words ON m(t) USING invtext")
    for how in ("KNN <->", "KNN <-->", "@@"):
        assert set(ids(engine, f"SELECT id FROM m WHERE t {how} 'playa' LIMIT 3")) == {1, 3, 5}
        assert ids(engine, f"SELECT id FROM m WHERE t {how} 'NIEVE unknown' LIMIT 1") == [2]
        assert ids(engine, f"SELECT id FROM m WHERE t {how} '?!'") == []
    run(engine, "INSERT INTO m VALUES (7, 'nieve nieve nieve'); DELETE FROM m WHERE id = 2")
    assert ids(engine, "SELECT id FROM m WHERE t KNN <-> 'nieve'") == [7]
    (r,) = run(engine, "SELECT id FROM m WHERE t KNN <-> 'techno'")
    assert set(r["data"][0]) == {"id", "t", "similarity"}
    assert r["meta"]["index_usage"][0]["index"] == "invtext"
    assert run(engine, "DROP INDEX words")[0]["ok"]


def test_text_by_formula(engine):
    import math
    import re

    docs = {1: "lorem ipsum dolor sit amet", 2: "ipsum dolor amet amet ipsum", 3: "quick brown fox jumps", 4: "lorem lorem quick"}
    run(engine, "CREATE TABLE d (id INT PRIMARY KEY, t TEXT); INSERT INTO d VALUES " + ", ".join(f"({i}, '{t}')" for i, t in docs.items()) + "; CREATE INDEX ON d(t) USING invtext")
    words = {i: re.findall(r"\w+", t) for i, t in docs.items()}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    vec = {i: {w: x.count(w) * math.log10(4 / df[w]) for w in x} for i, x in words.items()}
    (r,) = run(engine, "SELECT id FROM d WHERE t KNN <-> 'lorem' LIMIT 2")
    want = sorted(((v.get("lorem", 0) / math.sqrt(sum(x * x for x in v.values())), i) for i, v in vec.items() if "lorem" in v), reverse=True)
    assert [(round(x["similarity"], 9), x["id"]) for x in r["data"]] == [(round(s, 9), i) for s, i in want]


def test_audio(engine):
    run(engine, "CREATE TABLE s (audio_id INT PRIMARY KEY, file_name TEXT, file_path TEXT, tfidf_vector TEXT); INSERT INTO s VALUES (1,'a','/x/alpha.mp3',''),(2,'b','/x/beta.mp3',NULL),(3,'c','/x/gamma.mp3','[1, 2]'); CREATE INDEX ON s(file_path) USING audio")
    for how in ("<->", "<-->"):
        assert ids(engine, f"SELECT audio_id FROM s WHERE file_path KNN {how} '/elsewhere/beta.mp3' LIMIT 1", "audio_id") == [2]
        assert ids(engine, f"SELECT audio_id FROM s WHERE file_path KNN {how} '[1, 2]'", "audio_id") == [3]


def _png(path, gray):
    """A grayscale PNG."""
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in gray)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(engine, tmp_path):
    y, x = np.mgrid[0:256, 0:256]
    pictures = {"chk1": ((x // 32 + y // 32) % 2) * 255, "grad": x, "dark": (x + y) // 8, "circles": ((x - 128) ** 2 + (y - 128) ** 2) // 64 % 256}
    for n, g in pictures.items():
        _png(tmp_path / f"{n}.png", g)
    (tmp_path / "broken.png").write_bytes(b"no picture")
    values = ", ".join(f"({i}, '{tmp_path}/{n}.png')" for i, n in enumerate([*pictures, "broken", "missing"], 1))
    run(engine, f"CREATE TABLE p (id INT PRIMARY KEY, image_path TEXT); INSERT INTO p VALUES {values}; CREATE INDEX ON p(image_path) USING bovw")
    for how in ("<->", "<-->"):
        assert ids(engine, f"SELECT id FROM p WHERE image_path KNN {how} IMG('{tmp_path}/chk1.png') LIMIT 3")[0] == 1
    assert not run(engine, f"SELECT id FROM p WHERE image_path KNN <-> '{tmp_path}/missing.png'")[0]["ok"]


def test_csv(engine, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,price,ok,coords\n1,"x, y",1.5,yes,"1, 2"\n2,,2,no,"[3,4]"\n2,again,3,no,\n')
    (tmp_path / "b.csv").write_text("id,name,price,ok,coords\n2,old,9,t,\n3,new,7.25,f,\n")
    rs = run(engine, f"CREATE TABLE c FROM FILE '{tmp_path}/a.csv'; SELECT * FROM c; INSERT INTO c FROM FILE '{tmp_path}/b.csv'; SELECT id FROM c")
    assert [r["ok"] for r in rs] == [True] * 4
    assert rs[0]["meta"]["affected"] == 3
    assert sorted((r["id"], r["name"], r["price"], r["ok"]) for r in rs[1]["data"])[0][2:] == (1.5, True)
    assert sorted(r["id"] for r in rs[3]["data"]) == [1, 2, 3]
    assert engine.catalog.tables()["c"]["relation"][2] == {"name": "price", "type": "DOUBLE", "length": None}


def test_streaming_import(engine, tmp_path):
    from marlstone.streaming.ingest import follow_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,x\n2,y\n")
    run(engine, "CREATE TABLE s (id INT PRIMARY KEY, v TEXT); INSERT INTO s VALUES (1, 'kept')")
    for more in ("2,z\n3,w\n", ""):
        if more:
            (tmp_path / "in" / "b.csv").write_text("id,v\n" + more)
        follow_folder(engine.table("s"), str(tmp_path / "in"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(ids(engine, "SELECT id FROM s")) == [1, 2, 3]


def test_storage_calls(engine):
    t = engine.table("k")
    run(engine, "CREATE TABLE k (id INT PRIMARY KEY, name TEXT, at TEXT)")
    assert t.execute({"op": "build", "records": [{"id": 1, "name": "a", "at": "0,0"}, {"id": 1, "name": "b", "at": ""}, {"id": 2, "name": "c", "at": "3,4"}]}) == {"count": 2}
    assert [r["id"] for r in t.execute({"op": "rtree_within_circle", "field": "at", "center": (0, 0), "radius": 5})] == [1, 2]
    assert [r["id"] for r in t.execute({"op": "rtree_within_circle", "field": "at", "center": (3, 3), "radius": 5})] == [2, 1]
    assert [r["id"] for r in t.execute({"op": "get_all"})] == [1, 2]
    assert len(t.execute({"op": "rtree_range", "field": "at", "window": (0, 0, 1, 1)})) == 1
    assert t.execute({"op": "knn", "field": "at", "point": (3, 3), "k": 1})[0]["id"] == 2
    assert t.execute({"op": "remove", "field": "name", "value": "a"}) == {"affected": 1}
    assert t.execute({"op": "nothing"}) is None


def test_two_writers(engine, spark):
    run(engine, "CREATE TABLE w (id INT PRIMARY KEY)")
    m, n = engine.catalog.change("w")
    engine.catalog.save(m, n)
    with pytest.raises(FileExistsError):
        engine.catalog.save(m, n)


def test_manifest_of_files(spark, tmp_path):
    from marlstone.sources.media import manifest, sound_frames

    (tmp_path / "deep").mkdir()
    for n in ("b.mp3", "a.wav", "deep/c.MP3", "x.txt"):
        (tmp_path / n).write_bytes(b"abc")
    rows = manifest(spark, str(tmp_path), "audio").orderBy("audio_id").collect()
    assert [(r["audio_id"], r["file_name"]) for r in rows] == [(1, "a.wav"), (2, "b.mp3"), (3, "c.MP3")]
    frames = sound_frames(spark, str(tmp_path), lambda b: [[float(x) for x in b]] * 2)
    assert frames.count() == 8


def test_secondary_indexes(engine, spark):
    """Indexes on other columns are built at once, follow the data, are read instead of the table, and prune."""
    n = 3000
    rows = ", ".join(f"({i}, {(i * 37) % 500}, 'n{i % 50}', '{(i * 7) % 100},{(i * 13) % 100}')" for i in range(n))
    run(engine, f"CREATE TABLE s (id INT PRIMARY KEY, v INT, name TEXT, at TEXT); INSERT INTO s VALUES {rows}")
    want = {q: sorted(ids(engine, q)) for q in ("SELECT id FROM s WHERE v = 74", "SELECT id FROM s WHERE v BETWEEN 10 AND 12", "SELECT id FROM s WHERE name = 'n7'", "SELECT id FROM s WHERE at IN (POINT(50, 50), 5)", "SELECT id FROM s WHERE at = '7,13'")}
    want["SELECT id FROM s WHERE at BETWEEN '3,3' AND '20,9'"] = [i for i in range(n) if 3 <= i * 7 % 100 <= 20 and 3 <= i * 13 % 100 <= 9]  # a window only where an index says so
    rs = run(engine, "CREATE INDEX ON s(v) USING bplus; CREATE INDEX ON s(name) USING hash; CREATE INDEX ON s(at) USING rtree")
    assert all(r["ok"] for r in rs), rs
    for q, found in want.items():
        (r,) = run(engine, q)
        assert sorted(x["id"] for x in r["data"]) == found and found
        assert r["meta"]["index_usage"][0]["where"] == "secondary"
        assert r["meta"]["io"]["read"] >= 1
    t = engine.table("s")
    assert t.check_index("v") == t.check_index("name") == t.check_index("at") == []
    m = t.manifest
    assert "EqualTo(v,74)" in engine.explain("SELECT id FROM s WHERE v = 74")
    assert m.indexes["v"]["parts"][m.segments[0]] in engine.frame("SELECT id FROM s WHERE v = 74").inputFiles()[0]
    run(engine, "DELETE FROM s WHERE v = 11; INSERT INTO s VALUES (9001, 12, 'n7', '50,50'), (9002, 600, 'z', 'nowhere')")
    (r,) = run(engine, "SELECT id FROM s WHERE v BETWEEN 10 AND 12")
    assert sorted(x["id"] for x in r["data"]) == sorted([i for i in range(n) if (i * 37) % 500 in (10, 12)] + [9001])
    assert 9001 in ids(engine, "SELECT id FROM s WHERE at IN (POINT(50, 50), 0.5)")
    assert 9001 in ids(engine, "SELECT id FROM s WHERE name = 'n7'")
    assert run(engine, "SELECT id FROM s WHERE id = 5")[0]["meta"]["index_usage"] == [{"where": "primary", "index": "heap", "field": "id", "op": "search"}]


def test_text_index_tokenises_new_segments_only(engine):
    run(engine, "CREATE TABLE m (id INT PRIMARY KEY, t TEXT); INSERT INTO m VALUES (1, 'sea sand'), (2, 'snow ice'), (3, 'sea'); CREATE INDEX ON m(t) USING invtext")
    before = engine.table("m").manifest.indexes["t"]["parts"]
    run(engine, "INSERT INTO m VALUES (4, 'sand sand dune')")
    assert set(ids(engine, "SELECT id FROM m WHERE t KNN <-> 'sand'")) == {1, 4}
    after = engine.table("m").manifest.indexes["t"]["parts"]
    assert len(after) == 2 and all(after[s] == p for s, p in before.items())
    assert engine.table("m").check_index("t") == []
    fresh = {r["id"]: round(r["similarity"], 9) for r in run(engine, "SELECT id FROM m WHERE t KNN <--> 'sand'")[0]["data"]}
    assert fresh == {r["id"]: round(r["similarity"], 9) for r in run(engine, "SELECT id FROM m WHERE t KNN <-> 'sand'")[0]["data"]}


def test_small_segments_merge(engine):
    run(engine, "CREATE TABLE w (id INT PRIMARY KEY, v INT); CREATE INDEX ON w(v) USING bplus")
    for i in range(20):
        run(engine, f"INSERT INTO w VALUES ({i}, {i % 3})")
    assert len(engine.table("w").manifest.segments) < 16
    assert sorted(ids(engine, "SELECT id FROM w WHERE v = 1")) == [i for i in range(20) if i % 3 == 1]


def test_long_results_go_to_a_folder(spark, tmp_path):
    from marlstone.engine import Engine

    e = Engine(spark, str(tmp_path / "db"), most=5)
    e.run("CREATE TABLE k (id INT PRIMARY KEY); INSERT INTO k VALUES (1), (2), (3), (4), (5), (6), (7)")
    (r,) = e.run("SELECT id FROM k")["results"]
    assert len(r["data"]) == 5 and spark.read.parquet(r["meta"]["path"]).count() == 7
    (r,) = e.run("SELECT id FROM k WHERE id < 4")["results"]
    assert len(r["data"]) == 3 and "path" not in r["meta"]
    assert list(e.catalog.tables()) == ["k"]


def test_csv_types_by_all_rows(engine, tmp_path):
    (tmp_path / "a.csv").write_text("id,late,big,flag,mixed\n" + "".join(f"{i},{i},{i},yes,1\n" for i in range(500)) + f"500,word,{2**40},no,true\n")
    (tmp_path / "b.csv").write_text("id,late,big,flag,mixed\n600,x,much,perhaps,y\n601,y,7,t,n\n")
    rs = run(engine, f"CREATE TABLE c FROM FILE '{tmp_path}/a.csv'; SELECT late FROM c WHERE id = 500; INSERT INTO c FROM FILE '{tmp_path}/b.csv'")
    assert [f["type"] for f in engine.catalog.tables()["c"]["relation"]] == ["INT", "VARCHAR", "BIGINT", "BOOL", "VARCHAR"]
    assert rs[0]["meta"]["rejected"] == 0 and rs[1]["data"] == [{"late": "word"}]
    assert rs[2]["meta"]["affected"] == 2 and rs[2]["meta"]["rejected"] == 1


def test_vectors_of_declared_length(engine):
    run(engine, "CREATE TABLE v (id INT PRIMARY KEY, e VECTOR(3)); INSERT INTO v VALUES (1, '[1, 2]'), (2, '[1, 2, 3, 4]')")
    assert {r["id"]: r["e"] for r in run(engine, "SELECT id, e FROM v")[0]["data"]} == {1: [1.0, 2.0, 0.0], 2: [1.0, 2.0, 3.0]}


def test_term_counts(spark):
    from pyspark.sql import functions as F

    from marlstone.functions.text import term_counts

    rows = [("b a b c b A",), ("",), ("x",), ("?!",)]
    got = [{y["term"]: y["tf"] for y in r[0]} for r in spark.createDataFrame(rows, "t string").select(term_counts(F.col("t"))).collect()]
    assert got == [{"a": 2, "b": 3, "c": 1}, {}, {"x": 1}, {}]


def test_empty_inputs(engine, spark, tmp_path):
    """Files without rows, frames without rows, and segments in which no row has text."""
    (tmp_path / "e.csv").write_text("id,t\n")
    rs = run(engine, f"CREATE TABLE c FROM FILE '{tmp_path}/e.csv'; INSERT INTO c FROM FILE '{tmp_path}/e.csv'; SELECT * FROM c")
    assert [r["ok"] for r in rs] == [True] * 3 and rs[1]["meta"]["affected"] == 0 and rs[2]["data"] == []
    run(engine, "CREATE TABLE k (id INT PRIMARY KEY, t TEXT)")
    assert engine.table("k").build(spark.createDataFrame([], "id int, t string")) == 0
    run(engine, "INSERT INTO k VALUES (1, '  ')")
    assert not run(engine, "CREATE INDEX ON k(t) USING invtext")[0]["ok"]
    run(engine, "INSERT INTO k VALUES (3, 'sea'), (4, 'sand sea'); CREATE INDEX ON k(t) USING invtext; INSERT INTO k VALUES (5, ' ')")
    assert ids(engine, "SELECT id FROM k WHERE t KNN <-> 'sand'") == [4]


def _wave(samples, rate=22_050, width=2, channels=1) -> bytes:
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        full = 2 ** (8 * width - 1) - 1
        v = np.repeat(np.rint(np.asarray(samples) * full).astype(np.int64), channels)
        f.writeframes(b"".join(int(x + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for x in v))
    return out.getvalue()


def test_mfcc_by_formula():
    """One frame by the definitions, term by term."""
    from marlstone.functions import mfcc as M

    rate = 22_050
    y = np.sin(2 * np.pi * 440 * np.arange(6000) / rate) + 0.3 * np.random.default_rng(1).standard_normal(6000)
    got = M.mfcc(y, rate)
    assert got.shape == (1 + 6000 // M.HOP, 13)
    frames = []
    for t in range(len(got)):
        x = np.array([(y[i] if 0 <= i < len(y) else 0.0) for i in range(t * M.HOP - M.WINDOW // 2, t * M.HOP + M.WINDOW // 2)]) * np.sin(np.pi * np.arange(M.WINDOW) / M.WINDOW) ** 2
        frames.append([abs((x * np.exp(-2j * np.pi * k * np.arange(M.WINDOW) / M.WINDOW)).sum()) ** 2 for k in range(0, M.WINDOW // 2 + 1)] if t == 5 else None)
    bands = M.mel_filters(rate)
    assert bands.shape == (128, 1025) and np.allclose(bands[20:].sum(axis=1) * rate / M.WINDOW, 1, rtol=0.2)
    whole = np.lib.stride_tricks.sliding_window_view(np.pad(y, M.WINDOW // 2), M.WINDOW)[:: M.HOP] * np.sin(np.pi * np.arange(M.WINDOW) / M.WINDOW) ** 2
    loud = max(10 * np.log10(max(1e-10, (bands @ (abs(np.fft.rfft(f)) ** 2)).max())) for f in whole)
    db = [max(10 * np.log10(max(1e-10, float(b @ np.array(frames[5])))), loud - 80) for b in bands]
    want = [sum(d * np.cos(np.pi * k * (2 * n + 1) / 256) for n, d in enumerate(db)) * np.sqrt((1 if k == 0 else 2) / 128) for k in range(13)]
    assert np.allclose(got[5], want, atol=1e-6)


def test_mfcc_of_files(spark, tmp_path):
    from marlstone.sources.media import mfcc_extractor, sound_frames

    tone = lambda rate: 0.5 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    for name, data in {"a.wav": _wave(tone(22_050)), "b.wav": _wave(tone(44_100), 44_100, 3, 2), "c.wav": _wave(tone(22_050), width=1), "broken.wav": b"RIFF no sound", "empty.wav": _wave([])}.items():
        (tmp_path / name).write_bytes(data)
    frames = {}
    for r in sound_frames(spark, str(tmp_path), mfcc_extractor()).collect():
        frames.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["frame"])
    assert set(frames) == {"a.wav", "b.wav", "c.wav"}
    assert {len(x) for x in frames.values()} == {44} and {len(f) for x in frames.values() for f in x} == {13}
    a, b = np.array(frames["a.wav"])[5:-5], np.array(frames["b.wav"])[5:-5]
    assert np.abs(a[:, 1:4] - b[:, 1:4]).max() < 15  # the same tone at another rate, width and number of channels
