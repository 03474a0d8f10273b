"""Each stage of the corpus pipeline against brute force on its own input."""

import duckdb

import corpus_pipeline
from riskspark.llm import decontam, linechunks
from tests.llm.test_decontam import plain_lcs
from tests.llm.test_simhash import plain_groups

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in stages.items():
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, lines, single, clean, packed = tables
    assert all(t.columns == COLUMNS for t in tables[:5])

    # quality: what is labelled bad goes, what is labelled good stays
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows_of(good)
    share = {y: sum(d in kept for d, q in labels.items() if q == y) / sum(q == y for q in labels.values()) for y in (0, 1)}
    assert share[1] > 0.95 and share[0] < 0.1
    texts = rows_of(raw)
    assert all(kept[d].text == texts[d].text for d in kept)

    # lines: the SQL twin on the same input
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/quality_classifier/*.parquet')")
    r = con.execute(linechunks.SQL)
    cols = [d[0] for d in r.description]
    want = {x["doc_id"]: x["text"] for row in r.fetchall() if (x := dict(zip(cols, row))) and (not x["chunks_removed"] or 5 * len(x["text"]) >= len(kept[x["doc_id"]].text))}
    after = rows_of(lines)
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())

    # near copies: brute-force groups on the same input
    groups = plain_groups([(d, r.text) for d, r in sorted(after.items())])
    one = rows_of(single)
    assert set(one) == {c for _, _, c in groups}

    # benchmark: no document that stays holds an item, what goes holds most of one
    bench = [decontam.columns_of(r.text).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = rows_of(clean)
    plain = lambda r: " ".join(map(str, decontam.columns_of(r.text).tolist()))
    for d, r in one.items():
        held = any(f" {' '.join(map(str, b))} " in f" {plain(r)} " for b in bench)
        if d in left:
            assert not held
        else:
            assert held or max(plain_lcs(b, decontam.columns_of(r.text).tolist()) / len(b) for b in bench) >= 0.6

    # packing: every document is there once, whole
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(left)
    sizes = {}
    for r in pieces:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, empty tables and names that the operators use themselves."""
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    good = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 300 and 3000").limit(12).collect()]
    names = ["head", "_cut", "_wanted", "_hash", "_chars", "leak", "chars"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t) for i, t in enumerate(good)] + [(None, item), (None, good[0]), (7, item), (20, None), (21, ""), (22, good[3]), (22, good[3]), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *names) for d, t in rows], schema)
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        kept = [(r.doc_id, r.text) for r in out.collect()] if name != "best_fit_packing" else out.collect()
        assert kept and stage(spark, none, "/root/testdata/sf0.001").count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "benchmark_decontamination":
            assert (7, item) not in kept and (None, item) not in kept and (None, None) in kept
            assert set(rows) - set(kept) <= {(None, item), (7, item)} | {r for r in rows if r[1] and item in r[1]}
        if name == "simhash_near_dedup":
            assert kept.count((22, good[3])) == 0 and kept.count((3, good[3])) == 1
