import re
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    top, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        made.write.parquet(str(top / name))
        out.append((docs, spark.read.parquet(str(top / name))))
        docs = out[-1][1]
    return out


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == len(stages) == 5
    assert all(after.columns == before.columns for before, after in stages[:-1])
    assert all(after.count() <= before.count() for before, after in stages[:-1])


def test_quality_stage_keeps_the_good(spark, sf, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_near_dedup_stage_decides_at_the_similarity(stages):
    shingles = {}
    for r in stages[1][0].collect():
        w = r.text.encode().lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    low = {i: i for i in shingles}
    for a in sorted(shingles):
        for b in sorted(shingles):
            both = len(shingles[a] & shingles[b]) if b < a else 0
            if 5 * both >= 4 * (len(shingles[a]) + len(shingles[b]) - both) and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    assert {r.doc_id for r in stages[1][1].collect()} == set(low.values())


def test_decontamination_stage_leaves_no_window(spark, sf, stages):
    from vecstrata.llm import decontam

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.report(stages[2][1], bench).where("n_hit > 0").count() == 0
    clean = {r.doc_id for r in decontam.report(stages[2][0], bench).where("n_hit = 0").collect()}
    assert clean <= {r.doc_id for r in stages[2][1].collect()}


def test_secret_stage(stages):
    before = {r.doc_id: r.text for r in stages[3][0].collect()}
    for r in stages[3][1].collect():
        assert not re.search(r'(token = "|password=)[0-9a-f]{18,}|AKIA[A-Z0-9]{16}', r.text)
        if before[r.doc_id] != r.text:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)


def test_packing_stage(stages):
    library, seen, total = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(int), defaultdict(int)
    for r in stages[4][1].collect():
        seen[r.doc_id] += r.length
        total[r.sequence_id] += r.length
    assert dict(seen) == {r.doc_id: 1 + len(library.encode(r.text, add_special_tokens=False).ids) for r in stages[4][0].collect()}
    assert max(total.values()) <= 2048


def test_run_and_empty_tables(spark, sf, tmp_path):
    from vecstrata import scratch

    before = set(scratch._made)
    rows = corpus_pipeline.run(spark, sf).collect()
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(scratch._made) - before}
    assert "stage-quality_classifier" not in left and "shingled" not in left  # read by nobody any more
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edges_and_clashing_columns(spark, sf):
    names = ["n", "s", "p", "x", "node", "uid", "spans", "component", "n_words", "score", "kept", "path", "site", "value", "start", "piece", "length", "bin", "block"]
    text = " ".join(f"word{i % 37}" for i in range(60))
    rows = [(1, text, "en", "src1", 9), (1, text, "en", "src1", 9), (2, None, None, None, None), (3, "", "en", "a/b", 0), (None, text + " more", "en", None, 9), (4, "long " * 60000, "en", "src1", 300000), (5, text + " " * 800_000 + "end", "en", "src1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(1).alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        got = made.collect()
        assert made.columns == docs.columns or name == "best_fit_packing"
        assert len(got) == {"simhash_near_dedup": 3, "best_fit_packing": 5 + sum(r.doc_id in (4, 5) for r in got)}.get(name, len(got))
        if name in ("benchmark_decontamination", "secret_scans"):
            assert len(got) == 7
        assert stage(spark, docs.limit(0), sf).count() == 0
