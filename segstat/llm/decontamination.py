"""Benchmark passages in training documents, found by spaced seeds (JVM only).

Words are lower-cased runs without white space. A seed is a fixed mask over eight words of
which three positions are ignored, so a hit survives substituted words; the three masks together hit every stretch of
ten words of which any two are substituted. A hit names a diagonal (document position minus item position), and diagonals are
verified word by word: a window of at least ``MIN_WORDS`` words (or the whole item, if it is shorter) counts if it begins and ends with
an equal word and at least 80 % of it are equal, and a finding is a maximal run of words that lie in such windows.

Texts are first held against a bit table of the benchmark's seeds (three bits for each seed in a table of about 128
bits for each, at most ``MAX_BITS``): it lets no seed pass unseen and few others through. What passes is joined with the seeds. The
table is built by an aggregation and reaches tasks as one value, so neither the driver's plans nor its memory hold the seeds.

Defined cases: missing and empty texts have no words; items with fewer than eight words cannot be hit; long texts are read whole;
rows equal in every respect give equal findings once for each row of the document table; the same item
id with different texts counts as different items; extra columns play no part.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .tables import materialize

MASKS = ("11110001", "10101101", "10011011")
MIN_WORDS = 10
MIN_EQUAL = 80              # per cent
MAX_BITS = 1 << 27


def _words(text: str) -> str:
    return f"filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"


def _seeds(hashes: str, at: str, masks: tuple[str, ...]) -> list[str]:
    return [f"xxhash64({', '.join(f'{hashes}[{at} + {k}]' for k, bit in enumerate(m) if bit == '1')})" for m in masks]


def _places(hashes: str, masks: tuple[str, ...]) -> str:
    span = len(masks[0])
    return f"if(size({hashes}) >= {span}, sequence(0, size({hashes}) - {span}), array())"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _all_seeds(words: str, places: str, masks: tuple[str, ...]) -> str:
    """SQL for an array of (at, seed) over the given places."""
    each = ", ".join(f"named_struct('at', i, 'seed', {s})" for s in _seeds("h", "i", masks))
    return _let("h", f"transform({words}, x -> xxhash64(x))", f"flatten(transform({places.format(h='h')}, i -> array({each})))")


def items_of(benchmark: DataFrame, item_column: str = "item_id", text: str = "text") -> DataFrame:
    named = benchmark.select(F.col(item_column).alias("item"), F.col(text).cast("string").alias("t"))
    return named.select("item", F.xxhash64("t").alias("item_mark"), F.expr(_words("t")).alias("item_words")).where("item_words is not null").distinct()


def _bit_table(seeds: DataFrame, n: int, max_bits: int) -> tuple[DataFrame, int]:
    """One row ``bits``, an array of 64-bit words with three bits set for each seed, and the number of bits."""
    size = min(max_bits, 1 << max(6, (128 * n - 1).bit_length()))
    set_ = seeds.select("seed").distinct().select(F.expr(f"explode(array({', '.join(_bits('seed', size))}))").alias("at")) \
        .select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS int))").alias("bit"))
    every = set_.unionByName(seeds.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit")))
    words = every.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return words.agg(F.expr("transform(array_sort(collect_list(struct(word, bit))), x -> x.bit)").alias("bits")), size


def _bits(seed: str, size: int) -> list[str]:
    return [f"({seed} & {size - 1}L)", f"(shiftrightunsigned({seed}, 37) & {size - 1}L)", f"(xxhash64({seed}) & {size - 1}L)"]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
             item_column: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS,
             min_words: int = MIN_WORDS, min_equal: int = MIN_EQUAL, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, mark, item_id, doc_start, item_start, n_tokens, n_equal) of every verified overlap.

    ``mark`` is a hash of the document's text. Positions count words from 0.
    """
    items = materialize(items_of(benchmark, item_column, item_text), "items")
    seeds = items.select("item", "item_mark", F.size("item_words").alias("n_item"),
                         F.expr(f"explode({_all_seeds('item_words', _places('{h}', masks), masks)})").alias("s")) \
        .select("item", "item_mark", "n_item", F.col("s.at").alias("item_at"), "s.seed")
    seeds = materialize(seeds, "seeds")
    table, size = _bit_table(seeds, max(1, seeds.count()), max_bits)
    view = f"seed_bits_{uuid.uuid4().hex}"
    materialize(table, "seed-bits").createTempView(view)
    held = " AND ".join(f"(shiftright(bits[CAST(shiftright({p}, 6) AS int)], CAST({p} & 63 AS int)) & 1L) = 1L" for p in _bits("s", size))
    passed = _let("h", "transform(w, x -> xxhash64(x))", f"""flatten(transform({_places('h', masks)}, i -> filter(array(
        {", ".join(f"named_struct('at', i, 'seed', {s})" for s in _seeds("h", "i", masks))}), y -> {_let("s", "y.seed", held)})))""")
    hit = _let("bits", "bits", _let("w", _words("t"), f"named_struct('w', w, 'hits', {passed})"))
    # A scalar subquery: one value for all rows, which the optimiser moves into the expression that uses it.
    wide = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null") \
        .select("id", "t", F.expr(f"(SELECT bits FROM {view}) AS bits"))
    # Generate keeps the filter below from being computed twice.
    met = wide.select("id", F.xxhash64("t").alias("mark"), F.expr(f"{hit} AS hit")).select("id", "mark", F.expr("inline(array(hit))")).where("size(hits) > 0")
    spark = docs.sparkSession
    suspects = materialize(met.withColumn("row", F.monotonically_increasing_id()), "suspects")
    spark.catalog.dropTempView(view)
    found = suspects.select("row", F.expr("inline(hits)"))
    lines = found.join(seeds, "seed").select("row", "item", "item_mark", "n_item", (F.col("at") - F.col("item_at")).alias("line")).distinct()
    cut = lines.join(suspects.select("id", "mark", "row", "w"), "row").select("id", "mark", "item", "item_mark", "line", "n_item", F.expr(
        "slice(w, greatest(line, 0) + 1, least(size(w), line + n_item) - greatest(line, 0))").alias("part"))
    named = items.withColumnRenamed("item", "_item").withColumnRenamed("item_mark", "_item_mark")
    scored = cut.join(named, F.col("item").eqNullSafe(F.col("_item")) & (F.col("item_mark") == F.col("_item_mark")))
    equal = "transform(part, (x, i) -> x = item_words[i + greatest(-line, 0)])"
    runs = _let("least_words", f"least({min_words}, n_item)", _let("e", equal, _runs(min_equal)))
    scored = scored.select("id", "mark", "item", "line", F.expr(f"explode({runs})").alias("b"))
    return scored.select(
        "id", "mark", F.col("item").alias("item_id"),
        (F.greatest("line", F.lit(0)) + F.col("b.first")).cast("long").alias("doc_start"),
        (F.greatest(-F.col("line"), F.lit(0)) + F.col("b.first")).cast("long").alias("item_start"),
        F.expr("b.last - b.first + 1").cast("long").alias("n_tokens"), F.col("b.equal").cast("long").alias("n_equal"))


_FOUND = "array<struct<first: int, last: int, equal: int>>"


def _runs(min_equal: int) -> str:
    """SQL for the findings (first, last, equal) on a diagonal whose words are equal where ``e`` is true."""
    # c[k]: equal words among the first k; top[k]: most that 100 c exceeds its share by, after an equal word among the last k.
    counted = "aggregate(sequence(0, size(e) - 1), array(0), (a, i) -> concat(a, array(element_at(a, -1) + if(e[i], 1, 0))))"
    top = f"""aggregate(sequence(size(e) - 1, 0, -1), array(-2147483648), (a, i) ->
        concat(a, array(if(e[i], greatest(element_at(a, -1), 100 * c[i + 1] - {min_equal} * (i + 1)), element_at(a, -1)))))"""
    skip = f"NOT e[i] OR a.reach = size(e) - 1 OR top[size(e) - i - least_words + 1] < 100 * c[i] - {min_equal} * i"
    last = f"array_max(filter(sequence(greatest(i + least_words - 1, a.reach + 1), size(e) - 1), j -> e[j] AND 100 * (c[j + 1] - c[i]) >= {min_equal} * (j - i + 1)))"
    run = "named_struct('first', a.`from`, 'last', a.reach, 'equal', c[a.reach + 1] - c[a.`from`])"
    step = f"""if(z IS NULL, a, if(i <= a.reach + 1 AND a.reach >= 0, named_struct('found', a.found, 'from', a.`from`, 'reach', z),
        named_struct('found', if(a.reach < 0, a.found, CAST(concat(a.found, array({run})) AS {_FOUND})), 'from', i, 'reach', z)))"""
    found = f"""aggregate(sequence(0, size(e) - least_words), named_struct('found', CAST(array() AS {_FOUND}), 'from', 0, 'reach', -1),
        (a, i) -> if({skip}, a, {_let('z', last, step)}), a -> if(a.reach < 0, a.found, CAST(concat(a.found, array({run})) AS {_FOUND})))"""
    return f"if(size(e) < least_words, CAST(array() AS {_FOUND}), {_let('c', counted, _let('top', top, found))})"


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a verified overlap; all columns as they were, whatever their names."""
    bad = materialize(overlaps(docs, benchmark, id_column, text, **options).select(F.col("id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "leaks")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("own_id"), F.xxhash64(F.col(text).cast("string")).alias("own_mark"))
    left = packed.join(bad.hint("merge"), F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_mark") == F.col("bad_mark")), "left_anti")
    return left.select("row.*")


def _oracle() -> str:
    def windows(table: str, key: str) -> str:
        span = len(MASKS[0])
        tests = " UNION ALL ".join(
            "SELECT {k}, i, '{m}' || chr(31) || {w} AS seed FROM {t} WHERE n - i >= {span}".format(
                k=key, m=m, t=table, span=span,
                w=" || chr(31) || ".join(f"ws[i + {j + 1}]" for j, b in enumerate(m) if b == "1")) for m in MASKS)
        return f"({tests})"
    words = "[x for x in regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') if x <> '']"
    return f"""
WITH dw AS (SELECT doc_id, {words} AS ws FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, {words} AS ws FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(len(ws))) AS i FROM dw),
bp AS (SELECT item_id, ws, len(ws) AS n, unnest(range(len(ws))) AS i FROM bw),
ds AS {windows('dp', 'doc_id')}, bs AS {windows('bp', 'item_id')},
diagonal AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.i AS line FROM ds JOIN bs USING (seed)),
step AS (
  SELECT doc_id, item_id, line, least({MIN_WORDS}, len(b.ws)) AS least_words, b.i + line AS pos, b.i AS item_at,
         CASE WHEN dw.ws[b.i + line + 1] = b.ws[b.i + 1] THEN 1 ELSE 0 END AS eq
  FROM diagonal JOIN bp b USING (item_id) JOIN dw USING (doc_id) WHERE b.i + line >= 0 AND b.i + line < len(dw.ws)),
total AS (SELECT *, sum(eq) OVER (PARTITION BY doc_id, item_id, line ORDER BY pos) AS c FROM step),
far AS (
  SELECT a.doc_id, a.item_id, a.line, a.pos AS a, max(z.pos) AS z FROM total a JOIN total z USING (doc_id, item_id, line)
  WHERE a.eq = 1 AND z.eq = 1 AND z.pos - a.pos + 1 >= a.least_words AND 100 * (z.c - a.c + 1) >= {MIN_EQUAL} * (z.pos - a.pos + 1) GROUP BY ALL),
begun AS (
  SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id, item_id, line ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM far),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, line ORDER BY a) AS run FROM begun),
span AS (SELECT doc_id, item_id, line, run, min(a) AS a, max(z) AS z FROM numbered GROUP BY ALL)
SELECT span.doc_id, span.item_id, CAST(span.a AS BIGINT) AS doc_start, CAST(span.a - span.line AS BIGINT) AS item_start,
       CAST(span.z - span.a + 1 AS BIGINT) AS n_tokens, CAST(sum(eq) AS BIGINT) AS n_equal
FROM span JOIN step s ON s.doc_id = span.doc_id AND s.item_id = span.item_id AND s.line = span.line AND s.pos BETWEEN span.a AND span.z
GROUP BY span.doc_id, span.item_id, span.line, span.a, span.z"""


ORACLE_SQL = _oracle()
