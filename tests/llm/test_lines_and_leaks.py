import itertools
import random
import re

import pytest

from segstat.llm import decontamination, line_chunks
from segstat.llm.queries import op1_spaced_seeds, op7_line_chunks
from segstat.llm import queries


def words(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def brute(rows):
    """Lines of every pair of neighbouring lines with words, and every long line, that stand in an earlier place."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = (None, 0)
            continue
        lines = text.split("\n")
        worded = [k for k, x in enumerate(lines) if words(x)]
        spans = [(a, z) for a, z in zip(worded, worded[1:])] + [(k, k) for k in worded if len(words(lines[k])) >= line_chunks.LONG_WORDS]
        gone = set()
        for a, z in spans:
            t = (lines[a], lines[z]) if z > a else (lines[a],)
            if t in seen:
                gone |= set(range(a, z + 1))
            seen.add(t)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_chunks_of_lines(spark):
    rng = random.Random(2)
    pool = [f"line {i} of the text" for i in range(30)] + ["", " ", "é"]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(4, 12))] for _ in range(4)]
    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(1, 4)):
            body += rng.choice(passages) if rng.random() < 0.6 else [f"own {i} {rng.random()}" for _ in range(rng.randrange(5))]
        rows.append((i, "\n".join(body)))
    rows += [(60, None), (61, ""), (62, "\n\n\n"), (63, "\n\n\n"), (64, "a\nb\n" * 3000),
             (65, "x\n" + "long " * 50 + "\ny"), (66, "p\n" + "long " * 50 + "\nq"), (67, "p\n" + "long " * 49), (68, "z\n" + "long " * 49), (69, "word " * 60_000 + "\n\nend"), (70, "new\n" + "word " * 60_000 + "\n\nend")]
    docs = spark.createDataFrame([(i, t, 1, "k", None) for i, t in rows], "doc_id long, text string, n_lines int, start string, n_chars int").selectExpr("*", "1 AS _m", "2 AS row", "3 AS gone", "4 AS id", "5 AS mark").repartition(4)
    found = line_chunks.dedup_lines(docs)
    assert {"doc_id", "text", "start", "n_chars", "_m", "row", "gone", "id", "mark"} <= set(found.columns) and len(set(found.columns)) == len(found.columns)
    want = brute(rows)
    assert {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in found.collect()} == want
    assert sum(n for _, n in want.values()) > 50
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect() if r["n_removed_chunks"])
    assert line_chunks.dedup_lines(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4, 8, 20])
def test_repeated_passages_go_whole(spark, n):
    """A passage between foreign lines is removed from all documents but its first, whatever its length."""
    rows = [(i, "\n".join([f"own {i} a"] + [f"passage {n} line {k} of {n}" for k in range(n)] + [f"own {i} b"])) for i in range(20)]
    found = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: (t if i == 0 else f"own {i} a\nown {i} b") for i, t in rows}


def test_lines_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash of lengths only, the comparison of bytes decides."""
    real = line_chunks.chunks
    monkeypatch.setattr(line_chunks, "chunks", lambda *a: f"transform({real(*a)}, c -> named_struct('a', c.a, 'z', c.z, 'h', CAST(c.n AS bigint), 'n', c.n))")
    rows = [(1, "aa\nbb\ncc"), (2, "xx\naa\nbb"), (3, "aa\nbb\nzz"), (4, "aa\nzz")]
    found = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "aa\nbb\ncc", 2: "xx", 3: "zz", 4: "aa\nzz"}


def test_equal_rows_are_one_document(spark):
    text = "\n".join(f"some line {i}" for i in range(12))
    found = line_chunks.dedup_lines(spark.createDataFrame([(1, text), (1, text), (None, "x\ny"), (2, text)], "doc_id long, text string"))
    kept = sorted((r["doc_id"] or 0, r["n_removed_lines"] > 0) for r in found.collect())
    assert kept == [(0, False), (1, False), (1, False), (2, True)]


WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("max_bits", [1 << 27, 64])
def test_overlaps_tolerate_substitutions(spark, max_bits):
    rng = random.Random(5)
    item = [rng.choice(WORDS) for _ in range(40)]
    own = lambda n: [f"own{rng.randrange(10**9)}" for _ in range(n)]
    changed = list(item)
    for k in (3, 14, 27, 36):
        changed[k] = "other"
    docs = [(1, own(20) + item + own(5)), (2, own(3) + changed), (3, own(60)), (4, item[:9] + own(9)), (5, item[10:30]), (6, [x.upper() for x in item])]
    rows = [(i, "  ".join(t)) for i, t in docs] + [(7, None), (8, ""), (None, " ".join(item)), (9, " ".join(own(5) + item) + " z" * 20000), (1, docs[0] and "  ".join(docs[0][1]))]
    table = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, item_id int, seed string")
    bench = spark.createDataFrame([(0, " ".join(item), 1), (1, "too short", 1), (2, None, 1), (None, "", 1), (0, " ".join(item), 2)], "item_id long, text string, n_item int")
    found = decontamination.overlaps(table, bench, max_bits=max_bits).collect()
    got = sorted((r["id"] or 0, r["item_id"], r["doc_start"], r["item_start"], r["n_tokens"], r["n_equal"]) for r in found)
    assert got == [(0, 0, 0, 0, 40, 40), (1, 0, 20, 0, 40, 40), (1, 0, 20, 0, 40, 40), (2, 0, 3, 0, 40, 36), (5, 0, 0, 10, 20, 20), (6, 0, 0, 0, 40, 40), (9, 0, 5, 0, 40, 40)]
    kept = decontamination.decontaminate(table, bench, max_bits=max_bits)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7, 8]
    assert decontamination.overlaps(table.limit(0), bench, max_bits=max_bits).collect() == []
    assert decontamination.overlaps(table, bench.limit(0), max_bits=max_bits).collect() == []


def test_queries_match_sql(spark, small):
    import duckdb
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, run in (("op7_line_chunks", op7_line_chunks), ("op1_spaced_seeds", op1_spaced_seeds)):
        found = run(spark, small)
        columns = sorted(found.columns)
        want = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.CHECKS[name]})").fetchall()
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)


def stretches(eq, least=10):
    """Maximal runs of words that lie in windows which count."""
    n = len(eq)
    inside = set()
    for a in range(n):
        for z in range(a + least - 1, n):
            if eq[a] and eq[z] and 100 * sum(eq[a:z + 1]) >= 80 * (z - a + 1):
                inside |= set(range(a, z + 1))
    return [(a, next(z for z in range(a, n + 1) if z not in inside)) for a in sorted(inside) if a - 1 not in inside]


def test_every_stretch_that_counts(spark):
    rng = random.Random(7)
    item = [f"i{k}" for k in range(88)]
    patterns = [[k % 13 < 10 for k in range(88)]]                      # seven runs of ten, three substituted between
    patterns += [[True] * 12 + [False] * 30 + [True] * 14 + [False] * 22 + [True] * 10]     # three apart
    patterns += [[rng.random() < share for _ in range(88)] for share in [0.8] * 25 + [0.7] * 10]
    docs = [(i, " ".join(w if e else "other" for w, e in zip(item, eq))) for i, eq in enumerate(patterns)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = sorted((r["id"], r["doc_start"], r["item_start"], r["n_tokens"], r["n_equal"]) for r in found)
    hit = {i for i, eq in enumerate(patterns) if any(all(eq[a + k] for k, b in enumerate(m) if b == "1") for m in decontamination.MASKS for a in range(81))}
    assert got == sorted((i, a, a, b - a, sum(eq[a:b])) for i, eq in enumerate(patterns) if i in hit for a, b in stretches(eq))
    assert len([r for r in got if r[0] == 0]) == 1 and len([r for r in got if r[0] == 1]) == 3


def test_every_window_at_the_limit_is_hit():
    for gone in itertools.combinations(range(10), 2):
        eq = [k not in gone for k in range(10)]
        assert any(all(eq[a + k] for k, b in enumerate(m) if b == "1") for m in decontamination.MASKS for a in range(3))


def test_short_items_and_many_seeds(spark):
    nine = " ".join(f"n{k}" for k in range(9))
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(100_000))                 # 300,000 seeds
    bench = spark.createDataFrame([(1, nine), (2, "a b c d e f g"), (3, long)], "item_id long, text string")
    part = long.split()[777:800]
    docs = spark.createDataFrame([(1, f"x {nine} y"), (2, nine.replace("n4", "other")), (3, "a b c d e f g"), (4, " ".join(part)), (5, "p " * 200_000)], "doc_id long, text string")
    found = sorted((r["id"], r["item_id"], r["doc_start"], r["item_start"], r["n_tokens"], r["n_equal"]) for r in decontamination.overlaps(docs, bench).collect())
    assert found == [(1, 1, 1, 0, 9, 9), (2, 1, 0, 0, 9, 8), (4, 3, 0, 777, 23, 23)]
