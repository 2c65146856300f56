"""Each stage of the pipeline on what the one before kept, against a plain version of it."""

import importlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

from helpers import DATA
from test_joins import brute_jaccard
from test_text_ops import _check_packing, _targets, words

from marlstone.llm.scratch import stash

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
pipeline = importlib.import_module("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        rows_before = docs.collect()
        out = stash(stage(spark, docs, str(DATA)), name)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality_rules":
            kept = {r["doc_id"] for r in rows}
            assert all(before[i]["text"] == r["text"] for i, r in ((r["doc_id"], r) for r in rows))
            clean = [i for i in before if labels.get(i) == 1 and len(words(before[i]["text"])) >= 30]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        if name == "line_dedup":
            sites = defaultdict(set)
            first = {}
            for i, r in sorted(before.items()):
                for line in r["text"].split("\n"):
                    if bare := line.strip(" \t\n\x0b\x0c\r"):
                        sites[bare].add(r["source"])
                        first.setdefault(bare, i)
            for r in rows:
                left = [x for x in before[r["doc_id"]]["text"].split("\n") if len(sites[x.strip(" \t\n\x0b\x0c\r")]) < 10 or first[x.strip(" \t\n\x0b\x0c\r")] == r["doc_id"]]
                assert r["text"] == "\n".join(left)
        if name == "ngram_jaccard":
            assert {r["doc_id"] for r in rows} == {c for _, _, c in brute_jaccard([(i, r["text"]) for i, r in before.items()], 5, 80, 100)}
        if name == "mix_sources":
            size, got = Counter(), Counter()
            for r in before.values():
                size[r["source"]] += len(words(r["text"]))
            for r in rows:
                got[r["source"]] += len(words(r["text"]))
            assert {s: got[s] for s in size} == {s: int(x) for s, x in _targets(size).items()}
        if name == "best_fit_packing":
            once = {i: r["text"] for i, r in before.items()}
            times = Counter(r["doc_id"] for r in rows_before)
            single = [r for r in rows if times[r["doc_id"]] == 1]
            assert {r["doc_id"] for r in rows} == set(before)
            _check_packing_places(rows)
            used = {r["doc_id"]: once[r["doc_id"]] for r in single}
            _pieces_match(single, used)
        held[name] = rows
        docs = out
    assert pipeline.run(spark, str(DATA)).count() == len(held["best_fit_packing"])


def _check_packing_places(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]
        assert sum(n for _, n in x) <= 4096


def _pieces_match(rows, texts):
    alone = [dict(r.asDict(), sequence_id=k, offset=0) for k, r in enumerate(rows)]
    _check_packing(alone, texts)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stash(stage(spark, docs, str(DATA)), "none")
        assert docs.count() == 0
