"""Katz backoff bigram scores of whole documents, counted and evaluated in partitioned tables.

Tokens are lower-cased words and one end for each document; the first token follows a begin mark.

    P(w | v) = disc(c(v w)) / c(v)      if the pair was seen in training,
               alpha(v) * P(w)          otherwise (alpha = 1 if v was never seen before a token),
    P(w)     = disc(c(w)) / N           if the word was seen, else the mass left over, shared by no one: the unknown word.

disc(r) is the Good-Turing count of Katz for r up to 5 and r - 1/2 above, so every context keeps some mass;
alpha(v) is the mass left by the pairs of v over the unigram mass of the words not seen after v, from exact sums.

1. Word counts are combined in each task and dealt by word: N, V, counts of counts, and words with a 1,000th of all tokens.
2. Each task packs its tokens into blocks dealt by word (frequent words: by pair). The block's owner has c(w) and
   c(v w) for all its words, and adds up what needs nothing else; pairs seen up to 5 times are only counted by r. In training
   documents every pair is seen, so the factor 1 / c(v) is added where v itself is counted.
3. Sums over the followers of a context, and the tokens of held-out documents, meet by context
   (frequent contexts: in 16 copies), where alpha is computed and applied.
4. Sums are added for each document.

With ``pooled`` the buckets' counts of counts are added up after step 2, whose result is written, and one set of pair
discounts is applied in step 3: scores do not depend on the number of buckets. Without it each bucket of words (by hash) has the
discounts of its own pairs. alpha uses the discounted values themselves, so probabilities add up to 1 either way.

Defined cases: a missing text is empty (one token, the end); a missing id is never held out; repeated rows are
documents of their own; without training documents every token is unknown and its score is 0 in base and model (log of 1);
extra columns play no part.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytescan import U, Scan, mix, scan
from .tables import materialize, parts, pieces, text_of

END, BEGIN = U(1), U(2)            # no word hashes to these but by chance
TOP = 5                            # Good-Turing counts up to here
FREQUENT = 1000                    # words with one token in so many, or more, are split
COPIES = 16
_FLUSH = 1 << 21
_SLAB = 1 << 20


def discounted(n_r: np.ndarray, top: int = TOP) -> np.ndarray:
    """Discounted counts for r = 0..top from the numbers n_r[r] of types seen r times (up to top + 1)."""
    out = np.maximum(np.arange(top + 1) - 0.5, 0.0)
    if n_r[1] > 0:
        cut = (top + 1) * n_r[top + 1] / n_r[1]
        for r in range(1, top + 1):
            if n_r[r] > 0 and cut < 1:
                ratio = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - cut) / (1 - cut)
                if 0 < ratio < 1:
                    out[r] = r * ratio
    return out


def apply_discount(small: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.where(r < len(small), small[np.minimum(r, len(small) - 1)], r - 0.5)


@dataclass
class Unigrams:
    """What all tasks know of the words: totals, discounts and the frequent words (at most FREQUENT of them)."""
    total: int = 0
    types: int = 0
    small: np.ndarray = field(default_factory=lambda: np.zeros(TOP + 1))
    unknown: float = 1.0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0

    def frequent(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent words, and their places in the list."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, at

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, apply_discount(self.small, count) / max(1, self.total), self.unknown)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their documents and the number of tokens of each document."""
    s = scan(texts)
    data = s.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    s = Scan(data, s.starts, s.ends)
    starts, ends = s.words()
    n = s.per_text(starts) + 1
    token = np.full(int(n.sum()), END, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[np.cumsum(n) - 1] = False
    token[is_word] = s.hashes(starts, ends)
    return token, np.repeat(np.arange(len(n)), n), n


def _zip(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), codec="zstd", asbytes=True)


def _unzip(blob: bytes, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize * n for k, n in kinds)
    raw, at, out = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += np.dtype(kind).itemsize * n
    return out


def _step(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=U(0))


# --- 1: words -------------------------------------------------------------------------------

def _word_counts(texts: DataFrame, buckets: int) -> Unigrams:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            bucket = (key % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, hi - lo, _zip(_step(key[order[lo:hi]]), count[order[lo:hi]].astype(np.uint32)))
                    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "blob"])

        for batch in pieces(batches, "t", _SLAB):
            token, owner, _ = _tokens(batch.column(2))
            token = token[~batch.column(1).to_numpy(zero_copy_only=False)[owner]]
            held.append(token)
            n += len(token)
            if n >= _FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key, count = _unzip(blob, [("<u8", n), ("<u4", n)])
                keys.append(np.cumsum(key))
                counts.append(count)
        if not keys:
            return
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        n_r = np.bincount(np.minimum(count, TOP + 2), minlength=TOP + 3)
        often = (count * FREQUENT >= count.sum()) | (key == END)
        kind = [0] * (TOP + 2) + [1] + [2] * int(often.sum())
        name = np.concatenate([np.arange(1, TOP + 3), [0], key[often].view(np.int64)])
        value = np.concatenate([n_r[1:], [count.sum()], count[often]])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(name), pa.array(value)], names=["kind", "name", "value"])

    counted = texts.mapInArrow(deal, "bucket int, n long, blob binary").repartition(parts(texts.sparkSession), "bucket") \
        .mapInArrow(add, "kind int, name long, value long")
    counted = materialize(counted, "word-counts").groupBy("kind", "name").agg(F.sum("value").alias("value"))
    rows = counted.collect()
    total = sum(r["value"] for r in rows if r["kind"] == 1)
    if not total:
        return Unigrams()
    n_r = np.zeros(TOP + 3)
    for r in rows:
        if r["kind"] == 0:
            n_r[r["name"]] = r["value"]
    small = discounted(n_r)
    left = float((n_r[1:TOP + 1] * (np.arange(1, TOP + 1) - small[1:])).sum() + 0.5 * n_r[TOP + 1:].sum())
    listed = sorted((np.int64(r["name"]).view(np.uint64), r["value"]) for r in rows
                    if r["kind"] == 2 and r["value"] * FREQUENT >= total and np.int64(r["name"]).view(np.uint64) != END)
    documents = next(r["value"] for r in rows if r["kind"] == 2 and np.int64(r["name"]).view(np.uint64) == END)
    listed = sorted([*listed, (END, documents), (BEGIN, documents)])
    return Unigrams(int(total), int(n_r.sum()), small, left / total, np.array([k for k, _ in listed], np.uint64),
                    np.array([c for _, c in listed], np.int64), int(documents))


# --- 2: pairs -------------------------------------------------------------------------------

_BLOCK = "bucket int, kind int, slab long, n long, m long, k long, blob binary"
_DOCUMENTS, _PAIRS, _SUMS, _FOLLOWERS, _HELD, _COUNTS = range(6)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)],
                                      names=["bucket", "kind", "slab", "n", "m", "k", "blob"])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and their run lengths."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)


def _deal_pairs(uni: Unigrams, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            out = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[3] for h in held])
            w = np.concatenate([h[2] for h in held])
            v = np.roll(w, 1)
            v[np.cumsum(sizes) - sizes] = BEGIN
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes) * np.uint32(2) + out.repeat(sizes)
            filled = ids.fill_null(0).to_numpy()
            with np.errstate(over="ignore"):
                slab = mix(np.cumsum(mix(filled.view(np.uint64) + U(2) * out + U(len(out)))) + np.cumsum(mix(w))[-1:]).sum(dtype=np.uint64).view(np.int64)
            rows = [(int(slab.view(np.uint64) % U(buckets)), _DOCUMENTS, int(slab), len(out), 0, 0,
                     _zip(filled, ids.is_null().to_numpy(zero_copy_only=False), out, sizes.astype(np.int64)))]
            often, _ = uni.frequent(w)
            with np.errstate(over="ignore"):
                bucket = (np.where(often, mix(w + U(3) * v), w) % U(buckets)).astype(np.int64)
            order = np.lexsort((doc, v, w, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo:
                    at = order[lo:hi]
                    word, run_length = _runs(w[at])
                    context, place = np.unique(v[at], return_inverse=True)
                    rows.append((b, _PAIRS, int(slab), hi - lo, len(word), len(context),
                                 _zip(_step(word), run_length, _step(context), place.astype(np.uint32), doc[at])))
            return _rows(rows)

        for batch in pieces(batches, "t", _SLAB):
            token, _, sizes = _tokens(batch.column(2))
            held.append((batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), token, sizes))
            n += len(token)
            if n >= _FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _count_pairs(uni: Unigrams, buckets: int, pooled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            through = []
            for row in batch.to_pylist():
                if row["kind"] == _DOCUMENTS:
                    through.append(tuple(row.values()))
                else:
                    blocks.setdefault(row["bucket"], []).append(row)
            if through:
                yield _rows(through)
        for bucket in sorted(blocks):
            yield from _count_bucket(blocks.pop(bucket), uni, buckets, pooled)

    return run


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is emptied."""
    out = np.concatenate(arrays)
    arrays.clear()
    return out


def _by_count(where: np.ndarray, r: np.ndarray, size: int) -> list[np.ndarray]:
    """For each r from 1 to TOP, how often it stands at each place."""
    return [np.bincount(where[r == k], minlength=size).astype(np.uint32) for k in range(1, TOP + 1)]


def _count_bucket(blocks: list[dict], uni: Unigrams, buckets: int, pooled: bool) -> Iterator[pa.RecordBatch]:
    blocks.sort(key=lambda r: (r["slab"], r["n"], r["blob"]))
    words, contexts, docs, refs = [], [], [], []
    slabs, ref_of = [], {}
    for row in blocks:
        word, length, context, place, doc = _unzip(row["blob"], [("<u8", row["m"]), ("<u4", row["m"]), ("<u8", row["k"]), ("<u4", row["n"]), ("<u4", row["n"])])
        words.append(np.repeat(np.cumsum(word), length))
        contexts.append(np.cumsum(context)[place])
        docs.append(doc)
        if row["slab"] not in ref_of:
            ref_of[row["slab"]] = len(slabs)
            slabs.append(row["slab"])
        refs.append(np.full(row["n"], ref_of[row["slab"]], np.int64))
    blocks.clear()
    w, v, doc, ref = (_joined(x) for x in (words, contexts, docs, refs))
    order = np.lexsort((v, w))
    w, v, doc, ref = w[order], v[order], doc[order], ref[order]
    del order
    train = (doc & 1) == 0
    opens_word = np.concatenate([[True], w[1:] != w[:-1]])
    opens = opens_word | np.concatenate([[True], v[1:] != v[:-1]])
    pair = np.cumsum(opens) - 1
    pair_count = np.bincount(pair, train).astype(np.int64)
    word = np.cumsum(opens_word) - 1
    word_count = np.bincount(word, train).astype(np.int64)
    often, at = uni.frequent(w[opens_word])
    if often.any():
        word_count[often] = uni.counts[at[often]]
    n_r = np.bincount(np.minimum(pair_count[pair_count > 0], TOP + 2), minlength=TOP + 3)
    if pooled:
        yield _rows([(0, _COUNTS, k, int(n_r[k]), 0, 0, b"") for k in range(1, TOP + 3)])
    small = discounted(n_r.astype(float))
    r, c = pair_count[pair], word_count[word]
    later = r if pooled else np.zeros(len(r), np.int64)
    unigram = uni.probability(c)
    with np.errstate(divide="ignore"):
        score = np.where(r > 0, np.log10(apply_discount(small, np.maximum(r, 1))), np.log10(unigram))
        score[(later > 0) & (later <= TOP)] = 0.0
        score -= np.where(train & (w != END), np.log10(np.maximum(c, 1)), 0.0)
    base = np.log10((c + 1) / (uni.total + uni.types + 1))
    known = c > 0
    del pair, unigram, c
    # Sums for each document.
    key = (ref << 32) | (doc >> np.uint32(1)).astype(np.int64)
    each, where = np.unique(key, return_inverse=True)
    sums = [np.bincount(where, x) for x in (score, base, known)]
    rare = _by_count(where, later, len(each))
    del key, where, later, score, base, known
    cuts = np.searchsorted(each >> 32, np.arange(len(slabs) + 1))
    rows = []
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        if hi > lo:
            slab = slabs[k]
            rows.append((int(np.int64(slab).view(np.uint64) % U(buckets)), _SUMS, slab, hi - lo, 0, 0,
                         _zip((each[lo:hi] & 0xFFFFFFFF).astype(np.uint32), sums[0][lo:hi], sums[1][lo:hi], sums[2][lo:hi].astype(np.uint32), *[x[lo:hi] for x in rare])))
    if rows:
        yield _rows(rows)
    # What each context's seen followers sum up to in this bucket.
    seen = pair_count > 0
    context = v[opens][seen]
    followers, where = np.unique(context, return_inverse=True)
    n = pair_count[seen]
    later = n if pooled else np.zeros(len(n), np.int64)
    data = np.zeros(len(followers), [("v", "<u8"), ("n", "<i8"), ("mass", "<f8"), ("unigram", "<f8"), ("rare", "<u4", (TOP,))])
    data["v"], data["n"] = followers, np.bincount(where, n)
    data["mass"] = np.bincount(where, np.where((later > 0) & (later <= TOP), 0.0, apply_discount(small, n)))
    data["rare"] = np.stack(_by_count(where, later, len(followers)), 1)
    data["unigram"] = np.bincount(where, uni.probability(word_count[word[opens]][seen]))
    often, _ = uni.frequent(data["v"])
    copies = [data[~often]]
    for copy in range(COPIES):
        again = data[often].copy()
        again["v"] = _copy_of(again["v"], np.full(len(again), copy))
        copies.append(again)
    data = np.concatenate(copies)
    data = data[np.lexsort((data["v"], data["v"] % U(buckets)))]
    cuts = np.searchsorted((data["v"] % U(buckets)).astype(np.int64), np.arange(buckets + 1))
    rows = [(b, _FOLLOWERS, 0, hi - lo, 0, 0, _zip(_step(data["v"][lo:hi]), data["n"][lo:hi], data["mass"][lo:hi], data["unigram"][lo:hi], data["rare"][lo:hi].T))
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
    if rows:
        yield _rows(rows)
    # Tokens of held-out documents, by context.
    h = ~train
    if not h.any():
        return
    context, ref, doc, unseen = v[h], ref[h], (doc[h] >> np.uint32(1)), (r[h] == 0)
    often, _ = uni.frequent(context)
    ids = np.array(slabs, np.int64)
    context = np.where(often, _copy_of(context, (ids[ref].view(np.uint64) % U(COPIES)).astype(np.int64)), context)
    b = (context % U(buckets)).astype(np.int64)
    order = np.lexsort((doc, ref, unseen, context, b))
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    rows = []
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        if hi > lo:
            at = order[lo:hi]
            key, length = _runs(context[at])
            used, place = np.unique(ref[at], return_inverse=True)
            rows.append((k, _HELD, 0, hi - lo, len(key), len(used),
                         _zip(_step(key), length, ids[used], place.astype(np.uint32), doc[at], unseen[at])))
    yield _rows(rows)


def _copy_of(key: np.ndarray, copy: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return key + (copy.astype(np.uint64) + U(1)) * U(0xD1B54A32D192ED03)


# --- 3: contexts ----------------------------------------------------------------------------

_PART = "slab long, at int, tables int, id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _part(slab, at, tables=None, ids=None, held=None, n_tokens=None, n_known=None, base=None, score=None) -> pa.RecordBatch:
    n = len(at)
    give = lambda x, kind: pa.nulls(n, kind) if x is None else (x if isinstance(x, pa.Array) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(
        [give(slab, pa.int64()), give(at, pa.int32()), give(tables, pa.int32()), give(ids, pa.int64()), give(held, pa.bool_()), give(n_tokens, pa.int64()),
         give(n_known, pa.int64()), give(base, pa.float64()), give(score, pa.float64())],
        names=["slab", "at", "tables", "id", "held_out", "n_tokens", "n_known", "base", "score"])


def _weigh(small: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        followers, held, slab_lists = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                n, m, k, blob, slab = row["n"], row["m"], row["k"], row["blob"], row["slab"]
                if row["kind"] == _DOCUMENTS:
                    ids, missing, out, sizes = _unzip(blob, [("<i8", n), ("?", n), ("?", n), ("<i8", n)])
                    yield _part(np.full(n, slab), np.arange(n, dtype=np.int32), np.ones(n, np.int32), pa.array(ids, mask=missing), out, sizes)
                elif row["kind"] == _SUMS:
                    sums.setdefault(slab, []).append(_unzip(blob, [("<u4", n), ("<f8", n), ("<f8", n), *[("<u4", n)] * (1 + TOP)]))
                elif row["kind"] == _FOLLOWERS:
                    step, *rest = _unzip(blob, [("<u8", n), ("<i8", n), ("<f8", n), ("<f8", n), *[("<u4", n)] * TOP])
                    followers.append((np.cumsum(step), *rest))
                else:
                    step, length, ids, place, doc, unseen = _unzip(blob, [("<u8", m), ("<u4", m), ("<i8", k), ("<u4", n), ("<u4", n), ("?", n)])
                    held.append((np.repeat(np.cumsum(step), length), ids[place], doc, unseen))
        for slab, blocks in sums.items():
            at = np.concatenate([b[0] for b in blocks]).astype(np.int64)
            score, base, known, *rare = (np.bincount(at, np.concatenate([b[i] for b in blocks])) for i in range(1, 4 + TOP))
            score = score + np.log10(small[1:]) @ np.array(rare)
            there = np.flatnonzero(np.bincount(at))
            yield _part(np.full(len(there), slab), there.astype(np.int32), n_known=known[there].astype(np.int64), base=base[there], score=score[there])
        if not held:
            return
        v, slab, doc, unseen = (np.concatenate(x) for x in zip(*held))
        value = np.zeros(len(v))
        if followers:
            key, where = np.unique(np.concatenate([f[0] for f in followers]), return_inverse=True)
            count, mass, unigram, *rare = (np.bincount(where, np.concatenate([f[i] for f in followers])) for i in range(1, 4 + TOP))
            mass = mass + small[1:] @ np.array(rare)
            weight = np.log10((1 - mass / count) / (1 - unigram))
            at = np.minimum(np.searchsorted(key, v), len(key) - 1)
            value = np.where(key[at] == v, np.where(unseen, weight[at], -np.log10(count[at])), 0.0)
        names, ref = np.unique(slab, return_inverse=True)
        each, where = np.unique((ref.astype(np.int64) << 32) | doc, return_inverse=True)
        yield _part(names[each >> 32], (each & 0xFFFFFFFF).astype(np.int32), score=np.bincount(where, value))

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2,
          buckets: int | None = None, pooled: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Documents whose crc32(id as text) mod ``folds`` is ``held`` are scored but not learned from. ``pooled`` takes the
    pair discounts from all pairs instead of from those of each bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, parts(spark))
    out = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == held, F.lit(False))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), out.alias("held_out"), text_of(text).alias("t"))
    uni = _word_counts(texts, buckets)
    dealt = texts.mapInArrow(_deal_pairs(uni, buckets), _BLOCK).repartition(parts(spark), "bucket")
    counted = dealt.mapInArrow(_count_pairs(uni, buckets, pooled), _BLOCK)
    n_r = np.zeros(TOP + 3)
    if pooled:
        counted = materialize(counted, "pair-sums")
        for r in counted.where(F.col("kind") == _COUNTS).groupBy("slab").agg(F.sum("n").alias("types")).collect():
            n_r[r["slab"]] = r["types"]
        counted = counted.where(F.col("kind") != _COUNTS)
    summed = counted.repartition(parts(spark), "bucket").mapInArrow(_weigh(discounted(n_r)), _PART).groupBy("slab", "at").agg(
        F.sum("tables").alias("copies"), F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    # Equal slabs of equal rows share a number; their sums are equal, and each row comes back.
    share = summed.select("*", F.explode(F.expr("sequence(1, copies)")).alias("_copy"))
    begin = F.when(F.col("held_out"), 0.0).otherwise(F.lit(float(-np.log10(max(1, uni.documents)))))
    return share.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", F.expr("n_known div copies").alias("n_known"),
        F.lit(uni.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies") + begin).alias("score"))
