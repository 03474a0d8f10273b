"""Line chunks and line frequency: SQL twins, plain Python on planted cases, odd input."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskspark.llm import linechunks, linefreq

SCHEMA = "doc_id long, text string, source string, at int, first int, host string, lines int, chunk string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, 2, "x", 3, "y") for d, t, s in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


@pytest.mark.parametrize("name", ["op2_linechunks", "op9_linefreq"])
def test_against_sql(spark, name):
    from riskspark.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in r.description]
    want = sorted(r.fetchall(), key=repr)
    got = sorted((tuple(x) for x in queries.QUERIES[name](spark, sf).select(cols).collect()), key=repr)
    assert got == want


def test_planted_passage_goes_everywhere_but_once(spark):
    rng = random.Random(3)
    passage = "\n".join(sentence(rng, 12) for _ in range(24))
    rows = []
    for d in range(60):
        before, after = ("\n".join(sentence(rng, 9) for _ in range(rng.randint(1, 9))) for _ in range(2))
        rows.append((d, f"{before}\n{passage}\n{after}" if d % 3 == 0 else f"{before}\n{after}", "s"))
    texts = {d: t for d, t, _ in rows}
    got = {r.doc_id: r for r in linechunks.remove(frame(spark, rows)).collect()}
    lines = set(passage.split("\n"))
    assert got[0].text == texts[0]
    for d in range(60):
        own = [x for x in texts[d].split("\n") if x not in lines]
        kept = got[d].text.split("\n")
        assert [x for x in kept if x not in lines] == own, "lines of its own stay"
        if d % 3 == 0 and d:
            assert len(kept) - len(own) <= 6 and got[d].lines_removed >= 18
        elif d:
            assert got[d].chunks_removed == 0


def test_lines_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(linechunks, "line_id", lambda x: F.length(x).cast("bigint"))
    rows = [(1, "aa\nbb", "s"), (2, "cc\ndd", "s"), (3, "aa\nbb", "s")]
    assert {r.doc_id: r.text for r in linechunks.remove(frame(spark, rows)).collect()} == {1: "aa\nbb", 2: "cc\ndd", 3: ""}


def test_linechunks_odd_rows(spark):
    long = "\n".join(f"line {i}" for i in range(20000))
    rows = [(1, None, "s"), (2, "", "s"), (3, "\n\n\n", "s"), (4, "a\nb", "s"), (5, "a\nb", None), (5, "a\nb", None), (None, "a\nb", "s"), (6, long, "s"), (7, long, "s"),
            (8, "same\n" * 5000, "s")]
    df = linechunks.remove(frame(spark, rows))
    assert df.columns[:8] == ["doc_id", "text", "source", "at", "first", "host", "lines", "chunk"]
    got = sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    # the null id sorts first and so owns the chunk; the repeated rows of 5 are one document
    assert got == sorted([(1, None), (2, ""), (3, "\n\n\n"), (4, ""), (5, ""), (5, ""), (None, "a\nb"), (6, long), (7, ""), (8, "same\n" * 5000)], key=repr)
    assert linechunks.remove(frame(spark, [])).count() == 0


def test_many_repeated_hashes_take_the_other_join(spark, monkeypatch):
    rows = [(r.doc_id, r.text, "s") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(None, "a\nb", "s"), (7000, "a\nb", "s"), (7000, "a\nb", "s")]
    shown = lambda: sorted((tuple(r) for r in linechunks.remove(frame(spark, rows)).select("doc_id", "text", "chunks_removed", "lines_removed").collect()), key=repr)
    want = shown()
    monkeypatch.setattr(linechunks, "SEND_ROWS", 0)
    assert shown() == want


def test_a_long_line_is_a_passage_of_its_own(spark):
    rng = random.Random(9)
    passage = sentence(rng, 55)
    rows = [(d, "\n".join((sentence(rng, 9), passage, sentence(rng, 9), "short line of all")), "s") for d in range(5)] + [(9, passage, "s"), (10, passage, "s")]
    got = {r.doc_id: r.text.split("\n") for r in linechunks.remove(frame(spark, rows)).collect()}
    assert [passage in got[d] for d in (0, 1, 2, 3, 4, 9, 10)] == [True, False, False, False, False, False, False]
    assert all("short line of all" in got[d] for d in range(5))


def test_line_frequency_is_per_host_and_rejects_depleted(spark):
    rng = random.Random(5)
    menu = "Home  News\tAbout the company and its many friends all over the world today"
    rows = [(d, f"{menu.upper() if d % 2 else menu}\n{sentence(rng, 30)}", "a") for d in range(30)]
    rows += [(100 + d, f"{menu}\n{menu}\n{sentence(rng, 2)}", "a") for d in range(3)]
    rows += [(200 + d, f"{menu} {menu} {d}" if d else f"{menu}\n{sentence(rng, 25)}", "b") for d in range(30)]
    got = {r.doc_id: r for r in linefreq.apply_rules(frame(spark, rows)).collect()}
    assert all(got[d].words_removed == 14 and got[d].kept for d in range(30))
    assert all(got[d].lines_removed == 2 and not got[d].kept for d in range(100, 103))
    assert got[200].words_removed == 0 and got[200].kept


def plain_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_linefreq_odd_rows(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b", "# x # | <>", "x " * 30000, "\x85 \xa0 é", sentence(rng, 20), "a a a a a a a a a", " ".join(["p q r s t u v w"] * 2),
             " ".join(rng.choice("abc") for _ in range(500)), "l\nl \nl\n\n \nl"]
    rows = [(i, t, None if i % 2 else "h") for i, t in enumerate(texts)] + [(3, "a b", "h"), (None, "a b", "h")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in linefreq.apply_rules(frame(spark, rows)).collect()), key=repr)
    want = []
    for d, t, _ in rows:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        want.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), plain_repeats(words)))
    assert got == sorted(want, key=repr)
    assert linefreq.apply_rules(frame(spark, [])).count() == 0


def test_linefreq_cleaned_text(spark):
    rows = [(i, "Common  LINE of the site\n\n" + " ".join(f"w{i}x{k}" for k in range(30)) + "\ncommon line of the site", "s") for i in range(12)]
    rows += [(50, "too short", "s"), (51, None, "s"), (5, rows[5][1], "s")]
    got = sorted((r.doc_id, r.text, r.lines_removed) for r in linefreq.cleaned(frame(spark, rows)).collect())
    assert got == sorted((i, "\n" + " ".join(f"w{i}x{k}" for k in range(30)), 2) for i in [*range(12), 5])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id: r for r in linefreq.apply_rules(docs).where("kept").collect()}
    out = {r.doc_id: r for r in linefreq.cleaned(docs).collect()}
    assert set(out) == set(kept) and any(r.lines_removed for r in out.values())
    assert all(len(r.text.split()) == kept[d].n_words - kept[d].words_removed for d, r in out.items() if r.text.isascii())
