"""The pipeline against plain Python versions of its stages, each on what the stage before it kept."""
import re
import zlib

import numpy as np

import corpus_pipeline
from segstat.llm import decontamination, line_chunks, packing
from segstat.llm.queries import QUERIES, tokenizer_path
from segstat.llm.tables import materialize, read

from .test_lines_and_leaks import brute as brute_lines, stretches
from .test_packing import check_layout
from .test_quality import brute as brute_counts
from .test_simhash import brute_classes, brute_print


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def leaks(text, items):
    """Whether any diagonal with a seed hit has a window that counts."""
    doc = words(text)
    span = len(decontamination.MASKS[0])
    pick = lambda ws, i, m: (m, tuple(w for w, b in zip(ws[i:i + span], m) if b == "1"))
    for item in items:
        seeds = {}
        for m in decontamination.MASKS:
            for j in range(len(item) - span + 1):
                seeds.setdefault(pick(item, j, m), []).append(j)
        lines = {i - j for m in decontamination.MASKS for i in range(len(doc) - span + 1) for j in seeds.get(pick(doc, i, m), ())}
        for line in lines:
            equal = [doc[i] == item[i - line] for i in range(max(0, line), min(len(doc), line + len(item)))]
            if stretches(equal, min(decontamination.MIN_WORDS, len(item))):
                return True
    return False


def test_stages(spark, small):
    from tokenizers import Tokenizer
    docs = read(spark, small, "documents")
    columns, made = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), "test-stage")
        made.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in made] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    rows = {n: d.collect() for n, d in made}
    start = {r["doc_id"]: r for r in read(spark, small, "documents").collect()}
    good = {r["doc_id"]: r for r in rows["quality_rules"]}
    for i, r in start.items():
        counts = brute_counts(r["text"])
        if counts[0] < 50 or 100 * counts[4] > 50 * counts[0]:
            assert i not in good
    labels = {r["doc_id"]: r["quality"] for r in read(spark, small, "labels").collect()}
    passed = [i for i in labels if i in start and brute_counts(start[i]["text"])[0] >= 50 and 2 * brute_counts(start[i]["text"])[4] <= brute_counts(start[i]["text"])[0]]
    assert np.mean([(i in good) == (labels[i] == 1) for i in passed]) > 0.9
    assert all(good[i] == start[i] for i in good)
    lines = brute_lines([(i, r["text"]) for i, r in good.items()])
    cut = {r["doc_id"]: r["text"] for r in rows["line_dedup"]}
    assert cut == {i: t for i, (t, _) in lines.items()}
    ids = sorted(cut)
    classes = dict(zip(ids, brute_classes([brute_print(cut[i]) for i in ids], ids)))
    single = {r["doc_id"]: r["text"] for r in rows["near_duplicates"]}
    assert single == {i: cut[i] for i in ids if classes[i] == i}
    items = [words(r["text"]) for r in read(spark, small, "benchmark").collect()]
    clean = {r["doc_id"]: r["text"] for r in rows["decontamination"]}
    assert clean == {i: t for i, t in single.items() if not leaks(t, items)} and len(clean) < len(single)
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in clean.items():
        tokens = plain.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        want += [(i, k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in
                 enumerate(tokens[a:a + packing.LENGTH] for a in range(0, len(tokens), packing.LENGTH))]
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows["packing"]) == sorted(want)
    assert check_layout(rows["packing"], packing.LENGTH) <= -(-sum(w[2] for w in want) // packing.LENGTH) + 2


def test_odd_documents_pass_through(spark, small):
    base = read(spark, small, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", "en", "s", 0), (10_001, None, "en", "s", 0), (10_001, None, "en", "s", 0)], base.schema)
    docs = base.limit(20).unionByName(odd).selectExpr("*", "1 AS kept", "'x' AS n_lines", "2 AS fingerprint", "3 AS _row")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), small)
        assert empty.collect() == []
        found = materialize(stage(spark, docs, small), "odd-stage")
        assert found.count() > 0
        if name != "packing":
            assert found.columns == docs.columns


def test_every_operator_is_registered():
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and line_chunks.ORACLE_SQL
