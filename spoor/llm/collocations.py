"""Phrase collocations by suffix arrays over word ids, one for each shard of each language.

A task deals its texts into shards of bounded size, numbers the words of a shard in order and sorts its
suffixes by numpy prefix doubling, as deep as phrases are long. Runs of neighbours in that order whose longest
common prefix has at least m words (its LCP intervals) are the phrases of m words, with their counts. Counts
are merged globally by language and phrase.

Counts are exact and complete for every phrase that can matter. The first scan counts words and pairs. All
parts of a frequent phrase are frequent, so the second scan writes down what is left of the texts, stretches
of three words and more all of whose pairs are frequent, and counts its phrases of three words and more by
the bucket of their hash. A phrase in a bucket of fewer than min_count can't be frequent, in whatever task it
stands. So of what is left, phrases are put out only where their bucket is full, and longer ones only where all
phrases of three words are frequent too. Frequent phrases go to the tasks as a Bloom filter of at most
FILTER_WORDS words, buckets as at most BUCKETS bits; fuller ones let more pass, which costs time and
changes nothing. No list of phrases is ever collected.

A candidate is scored by its worst cut in two, in exact decimal arithmetic. Null texts are empty; texts without
words add nothing; a null language is und, together with rows that say und. Very long texts are a shard of
their own, in whole. Cuts that tie go to the shorter first part, phrases that tie in score to the more
frequent, then by bytes. Repeated rows count again; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import discard, prepare, small, text_of, written

#: What ends a piece, and what is between its words.
ENDS, GAPS = r"[.,;:!?\n\x0b\x0c\r]", "\t"
UNKNOWN = "und"
#: Bytes of text in a shard. A longer text is alone in one.
SHARD_BYTES = 8 << 20
#: Words that are left of shards, where phrases may be frequent, and sorted together.
LEFT_WORDS = 2_000_000
#: 64-bit words of the filter at most.
FILTER_WORDS = 1 << 21
#: Words of all texts for each bucket that longer phrases are counted by, buckets at most, and blocks that they are merged by.
WORDS_A_BUCKET, BUCKETS, BLOCKS = 16, 1 << 28, 64
#: Parts that a language's candidates are dealt into before its first ones are chosen.
DEALT = 64
MASK = np.uint64(63)


# ---- one shard, in numpy


def word_ids(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in order, as places in a sorted vocabulary, with -1 after each piece; and the vocabulary."""
    t = pc.replace_substring(pc.ascii_lower(texts.cast(pa.large_string())), GAPS, " ")
    t = pc.binary_join_element_wise(pc.replace_substring_regex(t, ENDS, " \n "), pa.scalar("\n", pa.large_string()), pa.scalar(" ", pa.large_string()))
    words = pc.split_pattern(t, " ").flatten()
    del t
    words = words.filter(pc.not_equal(words, "")).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()  # by bytes, so the mark of a piece's end needn't be first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    vocabulary = words.dictionary.take(pa.array(order))
    ids = place[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    mark = pc.index(vocabulary, pa.scalar("\n", vocabulary.type)).as_py()
    return np.where(ids == mark, -1, ids), vocabulary


def run_lengths(flags: np.ndarray) -> np.ndarray:
    """How many places in a row are true from each place on."""
    n = len(flags)
    stop = np.where(flags, n, np.arange(n))
    return (np.minimum.accumulate(stop[::-1])[::-1] if n else stop) - np.arange(n)


def words_left(ids: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its piece, 0 at an end."""
    return run_lengths(ids >= 0)


def only_runs(ids: np.ndarray, may: np.ndarray, size: int, least: int) -> np.ndarray:
    """ids of the stretches of least words and more all of whose phrases of size words may be frequent, with -1 behind each.

    may: whether the phrase of size words at a place may be. Stretches may share words, but no phrase of least.
    """
    runs = run_lengths(may)
    begins = np.flatnonzero((runs >= least - size + 1) & ~np.concatenate([[False], may[:-1]]))
    lengths = runs[begins] + size - 1
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    source = np.arange(len(out)) + np.repeat(begins - (ends - lengths - 1), lengths + 1)
    out[inside] = ids[source[inside]]
    return out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the words that follow them, at least depth of them, by prefix doubling."""
    n = len(ids)
    rank, k = ids + 1, 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        then = np.zeros(n, np.int64)
        then[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + len(ids) + int(rank.max(initial=0)) + 2) + then
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else 0
        rank, k = new, 2 * k
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Entry j: how many words suffix j has in common with the one before it in order, up to most; 0 for the first."""
    padded = np.concatenate([ids, np.full(most, -1, np.int64)])
    out = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for t in range(most):
        same &= padded[order[1:] + t] == padded[order[:-1] + t]
        out[1:] += same
    return out


def phrase_counts(ids: np.ndarray, left: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, a place of each phrase of m words, its count) by the intervals of common prefixes."""
    order = suffix_array(ids, longest)
    shared = common_prefixes(ids, order, longest)
    for m in range(shortest, longest + 1):
        starts = np.flatnonzero(shared < m)
        counts = np.diff(np.append(starts, len(order)))
        places = order[starts]
        whole = left[places] >= m
        yield m, places[whole], counts[whole]


def spelled(vocabulary: pa.Array, ids: np.ndarray, places: np.ndarray, m: int) -> pa.Array:
    """The phrases of m words at places."""
    parts = [vocabulary.take(pa.array(ids[places + t])) for t in range(m)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", vocabulary.type)) if m > 1 else parts[0]


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), 42) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def phrase_hashes(lang: str, h: np.ndarray, ids: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A hash of the phrases of size words at places: those of its words, h, each turned by its number, and its language's."""
    out = np.full(len(places), xxhash.xxh64_intdigest(lang.encode(), 42), np.uint64)
    for t in range(size):
        own = h[ids[places + t]]
        out ^= (own << np.uint64(t)) | (own >> np.uint64(64 - t)) if t else own
    return out


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = (np.uint64(1) << ((h >> np.uint64(s)) & MASK) for s in (40, 46))
    return (bits[h & np.uint64(len(bits) - 1)] & (one | two)) == one | two


def in_full(full: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the buckets of hashes are full. full: a bit for each bucket."""
    b = h & np.uint64(8 * len(full) - 1)
    return (full[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1


def added_up(held: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of all held, by bucket; counts over most are most."""
    at, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts], np.minimum(np.add.reduceat(n[order], starts), most)


# ---- the same hashes and filter in Spark


def _phrase_hash(lang: Column, words: Column, size: int) -> Column:
    out = F.xxhash64(lang)
    for t in range(size):
        own = F.xxhash64(words[t])
        out = out.bitwiseXOR(F.shiftleft(own, t).bitwiseOR(F.shiftrightunsigned(own, 64 - t)) if t else own)
    return out


def frequent_filter(phrases: DataFrame, size: int) -> np.ndarray:
    """The Bloom filter of phrases (lang, phrase) of size words: a power of two of 64-bit words, two bits a phrase, FILTER_WORDS at most."""
    words = 1 << min(FILTER_WORDS.bit_length() - 1, max(6, (phrases.count() // 2).bit_length()))
    h = phrases.select(_phrase_hash(F.col("lang"), F.split("phrase", " "), size).alias("h"))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", s).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    got = h.groupBy(F.col("h").bitwiseAND(F.lit(words - 1).cast("long")).alias("word")).agg(F.bit_or(bit(40).bitwiseOR(bit(46))).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


# ---- scans


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of SHARD_BYTES at most, or of one text."""
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for b in batches:
        for part in small([b], most=SHARD_BYTES):
            langs = part.column("lang")
            for lang in pc.unique(langs).to_pylist():
                own = part.column("t").filter(pc.equal(langs, lang))
                held.setdefault(lang, []).append(own)
                sizes[lang] = sizes.get(lang, 0) + own.nbytes
                total += own.nbytes
            while total >= SHARD_BYTES:
                lang = max(sizes, key=sizes.__getitem__)
                total -= sizes.pop(lang)
                yield lang, pa.concat_arrays(held.pop(lang))
    for lang, parts in held.items():
        yield lang, pa.concat_arrays(parts)


OUT = "lang string, size int, phrase string, n long"


def _rows(lang: str, size: int, phrases: pa.Array | None, counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts)
    phrases = pa.nulls(n, pa.string()) if phrases is None else phrases.cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrases, pa.array(counts.astype(np.int64))], ["lang", "size", "phrase", "n"])


def _phrases(lang: str, vocabulary: pa.Array, ids: np.ndarray, shortest: int, longest: int, full: np.ndarray | None = None, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The phrases of a shard with their counts, spelled a batch at a time. full: only those in full buckets."""
    h = None if full is None else word_hashes(vocabulary)
    for m, places, counts in phrase_counts(ids, words_left(ids), shortest, longest):
        if full is not None:
            may = in_full(full, phrase_hashes(lang, h, ids, places, m))
            places, counts = places[may], counts[may]
        for a in range(0, len(places), rows):
            yield _rows(lang, m, spelled(vocabulary, ids, places[a : a + rows], m), counts[a : a + rows])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words (size 0), words and pairs of each shard, with counts."""
    for lang, texts in _shards(batches):
        ids, vocabulary = word_ids(texts)
        if len(vocabulary) <= 1:
            continue
        yield _rows(lang, 0, None, np.array([np.count_nonzero(ids >= 0)]))
        yield from _phrases(lang, vocabulary, ids, 1, 2)


LEFT = "lang string, t string, block int, entries int, at binary, n binary"


def _left_rows(rows: list[dict]) -> pa.RecordBatch:
    names = {"lang": pa.string(), "t": pa.string(), "block": pa.int32(), "entries": pa.int32(), "at": pa.binary(), "n": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(names.items())))


def _left_texts(lang: str, vocabulary: pa.Array, ids: np.ndarray, words: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Stretches as texts of some words each, or of one stretch, with a line for each stretch."""
    ends = np.flatnonzero(ids < 0) + 1
    cuts = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(words, len(ids), words))], [len(ids)]]))
    spelt = pa.concat_arrays([vocabulary, pa.array(["\n"], vocabulary.type)]).take(pa.array(np.where(ids < 0, len(vocabulary), ids)))
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield _left_rows([{"lang": lang, "t": pc.binary_join(pa.ListArray.from_arrays([0, e - a], spelt[a:e]), pa.scalar(" ", spelt.type))[0].as_py()}])


def _left_counts(held: list[tuple[np.ndarray, np.ndarray]], buckets: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """Counts by bucket, a row for each block: steps between buckets, and counts. Counts over min_count needn't be told apart."""
    at, n = added_up(held, min_count)
    width = buckets // BLOCKS
    edges = np.searchsorted(at, np.arange(BLOCKS + 1, dtype=np.uint64) * np.uint64(width))
    for block, (a, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < e:
            steps = np.diff(at[a:e] - np.uint64(block * width), prepend=np.uint64(0)).astype(np.uint32)
            each = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (steps, n[a:e].astype(np.min_scalar_type(min_count)))]
            yield _left_rows([{"block": block, "entries": int(e - a), "at": each[0], "n": each[1]}])


def _left(batches: Iterator[pa.RecordBatch], bits, buckets: int, min_count: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The stretches of each shard all of whose pairs may be frequent, and the counts by bucket of their phrases of three words and more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lang, texts in _shards(batches):
        ids, vocabulary = word_ids(texts)
        h = word_hashes(vocabulary)
        places = np.flatnonzero(words_left(ids) >= 2)
        may = np.zeros(len(ids), bool)
        may[places] = may_hold(bits.value, phrase_hashes(lang, h, ids, places, 2))
        ids = only_runs(ids, may, 2, 3)
        if not len(ids):
            continue
        yield from _left_texts(lang, vocabulary, ids)
        left = words_left(ids)
        for m in range(3, longest + 1):
            held.append(np.unique(phrase_hashes(lang, h, ids, np.flatnonzero(left >= m), m) & np.uint64(buckets - 1), return_counts=True))
        if sum(len(at) for at, _ in held) >= LEFT_WORDS:
            yield from _left_counts(held, buckets, min_count)
            held = []
    if held:
        yield from _left_counts(held, buckets, min_count)


def _full(batches: Iterator[pa.RecordBatch], buckets: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """Which buckets of each block have min_count, as bits. Rows come by block, so that one block is held at a time."""
    now, width, kind = None, buckets // BLOCKS, np.min_scalar_type(min_count)
    row = lambda: pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "full": pa.array([np.packbits(sums >= min_count, bitorder="little").tobytes()], pa.binary())})
    for b in batches:
        for r in b.to_pylist():
            if r["block"] != now:
                if now is not None:
                    yield row()
                now, sums = r["block"], np.zeros(width, np.int64)
            steps = np.frombuffer(pa.decompress(r["at"], 4 * r["entries"], codec="zstd"), np.uint32)
            sums[np.cumsum(steps, dtype=np.int64)] += np.frombuffer(pa.decompress(r["n"], kind.itemsize * r["entries"], codec="zstd"), kind)
    if now is not None:
        yield row()


def full_buckets(left: DataFrame, buckets: int, min_count: int) -> np.ndarray:
    """A bit for each bucket: whether all tasks together counted min_count in it."""
    counts = left.filter("block is not null").select("block", "entries", "at", "n").repartition("block").sortWithinPartitions("block")
    got = counts.mapInArrow(partial(_full, buckets=buckets, min_count=min_count), "block int, full binary").toArrow()
    out = np.zeros((BLOCKS, buckets // BLOCKS // 8), np.uint8)
    for r in got.to_pylist():
        out[r["block"]] = np.frombuffer(r["full"], np.uint8)
    return out.ravel()


def _longer(batches: Iterator[pa.RecordBatch], full, bits, shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Phrases of shortest to longest words, with counts, in full buckets, where all their parts of three words may be frequent.

    bits: the filter of those parts, or None before they are known; then their buckets tell. What is left of a
    shard is little, so that of many shards goes into one suffix array.
    """
    held: dict[str, list[np.ndarray]] = {}
    known: dict[str, dict[str, int]] = {}

    def sorted_out(lang: str) -> Iterator[pa.RecordBatch]:
        yield from _phrases(lang, pa.array(list(known.pop(lang)), pa.large_string()), np.concatenate(held.pop(lang)), shortest, longest, full.value)

    for lang, texts in _shards(batches):
        ids, vocabulary = word_ids(texts)
        places = np.flatnonzero(words_left(ids) >= 3)
        h = phrase_hashes(lang, word_hashes(vocabulary), ids, places, 3)
        may = np.zeros(len(ids), bool)
        may[places] = in_full(full.value, h) if bits is None else may_hold(bits.value, h)
        ids = only_runs(ids, may, 3, shortest)
        if not len(ids):
            continue
        used, at = np.unique(ids, return_inverse=True)  # the first is -1, as every stretch ends with it
        own = known.setdefault(lang, {})
        number = np.array([-1, *(own.setdefault(w, len(own)) for w in vocabulary.take(pa.array(used[1:])).to_pylist())])
        held.setdefault(lang, []).append(number[at])
        if sum(map(len, held[lang])) >= LEFT_WORDS:
            yield from sorted_out(lang)
    for lang in list(held):
        yield from sorted_out(lang)


def counted(docs: DataFrame, min_count: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, n of all words), and (lang, size, phrase, f) of every phrase of 1 to longest words with f of at least min_count."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("t"))

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= min_count) | (F.col("size") == 0))

    short = written(merged(rows.mapInArrow(_short, OUT)), "phrases")
    totals = short.filter("size = 0").select("lang", F.col("f").alias("n"))
    frequent = short.filter("size > 0")
    if longest < 3:
        return totals, frequent
    send = docs.sparkSession.sparkContext.broadcast
    known = lambda size: send(frequent_filter(frequent.filter(F.col("size") == size), size))
    words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << min(BUCKETS.bit_length() - 1, max(12, (words // WORDS_A_BUCKET).bit_length()))
    left = written(rows.mapInArrow(partial(_left, bits=known(2), buckets=buckets, min_count=min_count, longest=longest), LEFT), "left")
    full = send(full_buckets(left, buckets, min_count))
    texts = left.filter("block is null").select("lang", "t")
    for shortest, most in ((3, 3), (4, longest)):
        if most >= shortest:
            bits = known(3) if shortest > 3 else None
            found = texts.mapInArrow(partial(_longer, full=full, bits=bits, shortest=shortest, longest=most), OUT)
            frequent = frequent.unionByName(written(merged(found), "phrases"))
    discard(left)
    return totals, frequent


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exactly: products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide(a) * wide(n)), wide(l) * wide(r)).cast("long")


def cut_scores(totals: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, size, phrase, a, l, r, n, score of phrases of two words and more, by the cut with the lowest score, then the shortest first part."""
    words = F.split("phrase", " ")
    cuts = frequent.filter("size >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("tail"))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    scored = scored.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "size", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "size", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_parts(scored: DataFrame, percent: int = 100) -> DataFrame:
    """scored without phrases that stand in a longer one of the same language with at least percent of their count."""
    words = F.split("phrase", " ")
    parts = scored.filter("size >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    parts = parts.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(parts, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, most: int = 2000, percent: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first most phrases of each language."""
    scored = written(cut_scores(*counted(docs, min_count, longest, lang_col, text_col)), "scored")
    rest = without_parts(scored, percent)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = rest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))  # a language's candidates may be many
    first = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_n") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
