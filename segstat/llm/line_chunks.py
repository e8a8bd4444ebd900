"""Repeated passages of lines, found by content-defined chunks of lines (JVM only).

Values of lines come from a hash; a rolling hash over two neighbouring lines with words (blank lines between them do not count)
opens a chunk of these two where it falls on residue 0 of ``divisor``. Boundaries so depend on the passage alone and move with
it. With the default divisor 1 every pair of neighbours is a chunk: wider chunks lose short passages, because
both of their ends must fall inside (README has figures). A line of ``LONG_WORDS`` words or more is a chunk of its own.
Chunks are counted over all documents by a 64-bit hash and their length; where a hash repeats, the bytes of the chunk's
lines are compared with those of its first occurrence (smallest id, then earlier start), and equal later chunks are removed with the
blank lines inside. Overlapping chunks join up, so a removed run is as long as the repeated passage. First occurrences stay.

The comparison takes the least and the greatest text of all lines that must be equal, added up before the
shuffle: a passage that a third of the documents share is a few rows there. Only where these differ are single lines compared.

Defined cases: missing texts stay missing and have no chunks; blank lines alone are never removed; rows equal in id and text are one
document and are treated alike; a missing id orders before all others; long texts are read whole; extra columns pass through
whatever their names, but for n_lines, n_removed_lines and n_removed_chunks, which are replaced; ``n_chars``, where present and
its text was cut, is set to the new length; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import materialize

DIVISOR = 1
LONG_WORDS = 50

_SPACE = r"[\\x20\\x09-\\x0D]+"
_WORD = r"[^\\x20\\x09-\\x0D]"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def chunks(text: str, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> str:
    """SQL for the chunks of a text: array of (a, z, h, n), its first and last line, hash and bytes."""
    worded = f"filter(transform(l, (x, i) -> named_struct('i', i, 'x', x)), p -> p.x rlike '{_WORD}')"
    valued = "transform(w, p -> xxhash64(p.x))"
    pair = """named_struct('a', w[k].i, 'z', w[k + 1].i, 'h', xxhash64(v[k], v[k + 1]), 'n', octet_length(w[k].x) + octet_length(w[k + 1].x) + 1)"""
    rolled = "" if divisor == 1 else f", k -> pmod(shiftright(v[k], 8) * 31 + shiftright(v[k + 1], 8), {divisor}) = 0"
    places = "sequence(0, size(w) - 2)"
    pairs = f"if(size(w) < 2, array(), transform({f'filter({places}{rolled})' if rolled else places}, k -> {pair}))"
    # Fewer bytes than 2 * long_words - 1 cannot hold so many words.
    is_long = f"octet_length(p.x) >= {2 * long_words - 1} AND size(filter(split(p.x, '{_SPACE}'), y -> y <> '')) >= {long_words}"
    alone = f"transform(filter(w, p -> {is_long}), p -> named_struct('a', p.i, 'z', p.i, 'h', xxhash64(p.x), 'n', octet_length(p.x)))"
    return _let("l", f"split({text}, '\\n', -1)", _let("w", worded, _let("v", valued, f"concat({pairs}, {alone})")))


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, mark, a, z) of every chunk whose bytes occur earlier; mark is a hash of the document's text."""
    wide = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null")
    opened = wide.select("id", F.xxhash64("t").alias("mark"), F.expr(f"inline({chunks('t', divisor, long_words)})"))
    found = materialize(opened, "chunks")
    place = F.struct("id", "mark", "a", "z")
    # Equal rows give equal places, so least and greatest place tell whether a chunk stands in two.
    often = found.groupBy("h", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "n", "first")
    later = materialize(found.join(often, ["h", "n"]).where(~place.eqNullSafe(F.col("first"))).select("id", "mark", "a", "z", "first"), "later-chunks")
    checks = later.select("id", "mark", F.expr("explode(if(a = z, array(struct(a AS line, first.a AS at)), array(struct(a AS line, first.a AS at), struct(z AS line, first.z AS at))))").alias("c"), "first") \
        .select("id", "mark", "c.line", F.struct(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"), F.col("c.at").alias("line")).alias("first")).distinct()
    firsts = checks.select("first").distinct().select("first.*", "first")
    needed = materialize(checks.unionByName(firsts).groupBy("id", "mark").agg(F.collect_list(F.struct("line", "first")).alias("needs")), "line-checks")
    texts = _line_texts(wide, needed)
    uneven = materialize(texts.groupBy("first").agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least <> most").select("first"), "uneven-lines")
    if uneven.isEmpty():
        return later.select("id", "mark", "a", "z")
    # Lines of one hash with different bytes: each is held against the first one's bytes.
    some = materialize(texts.join(uneven, "first"), "uneven-texts")
    own = some.where((F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("mark") == F.col("first.mark")) & (F.col("line") == F.col("first.line")))
    other = some.join(own.select("first", F.col("x").alias("first_x")), "first").where("x <> first_x").select("id", "mark", "line", "first")
    wrong = other.select(F.col("id").alias("o_id"), F.col("mark").alias("o_mark"), F.col("line").alias("o_line"), F.col("first").alias("o_first"))
    meets = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("mark") == F.col("o_mark")) & F.col("first.id").eqNullSafe(F.col("o_first.id")) & (F.col("first.mark") == F.col("o_first.mark")) & (
        ((F.col("a") == F.col("o_line")) & (F.col("first.a") == F.col("o_first.line"))) | ((F.col("z") == F.col("o_line")) & (F.col("first.z") == F.col("o_first.line"))))
    return later.join(wrong, meets, "left_anti").select("id", "mark", "a", "z")


def _line_texts(wide: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, mark, line, first, x) of every line to be compared, with its text."""
    marked = wide.select(F.col("id").alias("_id"), "t", F.xxhash64("t").alias("_mark"))
    # Sort-merge at every size: texts are dealt once by id, whatever the share of documents with repeats.
    met = marked.join(needed.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark")))
    return met.select("id", "mark", F.expr("inline(" + _let("l", "split(t, '\\n', -1)", "transform(needs, y -> named_struct('line', y.line, 'first', y.first, 'x', l[y.line]))") + ")"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents without repeated chunks, with n_lines, n_removed_lines and n_removed_chunks."""
    gone = repeated_chunks(docs, id_column, text, divisor, long_words) \
        .groupBy("id", "mark").agg(F.collect_set(F.struct("a", "z")).alias("gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_column).alias("own_id"), F.col(text).cast("string").alias("t")) \
        .withColumn("own_mark", F.xxhash64("t"))
    met = own.join(gone.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")), "left")
    done = met.select("row", "t", "gone", F.expr(f"CASE WHEN gone IS NOT NULL THEN {_kept()} END").alias("kept"))
    cut = F.col("kept").isNotNull()
    columns = []
    for c in names:
        old = F.col("row").getField(c)
        if c == text:
            old = F.when(cut, F.col("kept.text")).otherwise(old)
        elif c == "n_chars":
            old = F.when(cut, F.length("kept.text").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    lines = F.when(F.col("t").isNull(), 0).otherwise(F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1)
    return done.select(*columns, lines.cast("long").alias("n_lines"), F.coalesce("kept.removed", F.lit(0)).cast("long").alias("n_removed_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"))


def _kept() -> str:
    """SQL for the text of the lines outside the removed chunks, and how many lie inside."""
    left = "array_except(sequence(0, size(l) - 1), flatten(transform(gone, g -> sequence(g.a, g.z))))"
    return _let("l", "split(t, '\\n', -1)", _let("k", left, "named_struct('text', array_join(transform(k, i -> l[i]), '\\n'), 'removed', size(l) - size(k))"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT *, lead(i) OVER w AS z, lead(x) OVER w AS y FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
chunk AS (
  SELECT doc_id, i AS a, z, x || chr(10) || y AS t FROM worded WHERE z IS NOT NULL
  UNION ALL SELECT doc_id, i, i, x FROM worded WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {LONG_WORDS}),
gone AS (SELECT doc_id, a, z FROM chunk QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a) > 1),
inside AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM gone),
cut AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id),
kept AS (
  SELECT lines.doc_id, count(*) AS n_lines, count(inside.i) AS n_removed_lines,
         coalesce(string_agg(CASE WHEN inside.i IS NULL THEN x END, chr(10) ORDER BY lines.i), '') AS t
  FROM lines LEFT JOIN inside USING (doc_id, i) GROUP BY lines.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
       CAST(coalesce(c, 0) AS BIGINT) AS n_removed_chunks, md5(t) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)"""
