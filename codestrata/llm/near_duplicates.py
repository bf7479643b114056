"""Near-duplicate records with small edits (problem 6), by token-combination prefixes.

A record's tokens are its word shingles. They are ordered by rarity (document frequency, then hash) and put into
classes: rare tokens are posted alone, frequent ones only in pairs of one class, classes being made by hash. The
prefix is extended until it holds more tokens than a partner above the threshold can lack, counted by class: if no
pair were shared, at most one token of each class of frequent ones could be. So two similar records share a
signature, while frequent tokens never make a posting list of their own.

The number of classes follows the size of the set, (1 - threshold) times the size read down to a power of two, so a record posts
signatures in proportion to its length, not to its square. Both of a pair must count by the same classes: those of the shorter one's
grade. A record therefore posts under its own grade and, where a shorter partner may be of a grade below, under that as well. Where
one common token can be all that two sets need (sets of one token, at thresholds above one half), no combination
exists: these post the single tokens of the plain prefix.

Candidates pass a size filter and a bitmap bound of the overlap and
are verified exactly on their texts. Groups are the components of the verified links.

Equal texts are one class from the start. A posting list with more than ``ALL_PAIRS`` classes is linked by a chain and a star first;
pairs of its members that are in different components then are tried as well, so no link that could join
two groups is left out. In such a list the members outside its largest component meet all others, in blocks of ``BLOCK`` by
``BLOCK``, so that no task holds the list; a hot group of near copies, which is that component, costs as much as its members.

Defined cases: a null text is empty; texts with fewer than ``least_words`` words are in no group; repeated rows
are one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import WORD
from codestrata.llm.census import U, ask, decode, encode, mix, pack_rows, range_starts, ranges_for, read_answers, with_answers
from codestrata.operators.components import connected_components
from codestrata.session import cut

BATCH_CHARS = 4_000_000
RARE = 48  # most records with a token that is posted alone
ALL_PAIRS = 96
BLOCK = 2000
POSTINGS_A_RANGE = 400_000
POSTINGS_A_CHAR = 0.3  # at the most, in texts of words
BITS = 128

_WORDS = re.compile(r"\w+")
_cache: dict[str, int] = {}


def _word_hash(w: str) -> int:
    if (h := _cache.get(w)) is None:
        if len(_cache) > 1_000_000:
            _cache.clear()
        h = _cache[w] = xxhash.xxh3_64_intdigest(w)
    return h


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def token_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, hash) of the different k-word shingles of each text, ordered by both."""
    flat: list[int] = []
    sizes = []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        flat += map(_word_hash, w)
    a, rec = np.array(flat, U), np.repeat(np.arange(len(texts)), sizes)
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = np.zeros(n, U)
    for i in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + a[i : n + i] + U(i + 1))
    inside = rec[:n] == rec[k - 1 :]
    h, rec = h[inside], rec[:n][inside]
    order = np.lexsort((h, rec))
    h, rec = h[order], rec[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
    return rec[keep], h[keep]


def short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash: enough for frequencies, which only order the tokens."""
    return h >> U(16) << U(16)


def grade(n: np.ndarray) -> np.ndarray:
    """Whole binary logarithm."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def classes_of(grades: np.ndarray, threshold: float) -> np.ndarray:
    """Classes of frequent tokens in sets of 2^grade tokens or more: fewer than the tokens that two of them must share."""
    size = np.exp2(grades)
    return np.maximum(1, np.minimum(np.rint((1 - threshold) * size), np.ceil(threshold * size - 1e-9) - 1)).astype(np.int64)


def signatures(rec: np.ndarray, h: np.ndarray, df: np.ndarray, threshold: float, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(signature, record) of the extended prefixes."""
    order = np.lexsort((h, df, rec))
    rec, h, df = rec[order], h[order], df[order]
    n = np.bincount(rec) if len(rec) else np.zeros(0, np.int64)
    size = n[rec]
    need = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    begin = (np.cumsum(n) - n)[rec]
    place = np.arange(len(rec)) - begin
    frequent = df > rare
    own = grade(np.maximum(size, 1))
    tiny = int(1 / threshold + 1e-9)  # largest set that may share one token only with a partner
    lowest = grade(np.maximum(np.ceil(threshold * size - 1e-9), tiny + 1).astype(np.int64))
    alone = (threshold * size <= tiny + 1e-9) & (place < need) & (df > 1)
    single = np.zeros(len(rec), bool)
    out_s, out_r = [mix(h[alone] ^ U(0xA5A5A5A5))], [rec[alone]]
    for below in range(int(np.ceil(-np.log2(threshold))) + 1):
        g = own - below
        here = (size > tiny) & (g >= lowest)
        level = np.where(frequent, (h % classes_of(g, threshold).astype(U)).astype(np.int64), -1)
        # Tokens up to each one that a partner without a common signature must lack: all but the first of each class.
        key = rec * (1 << 31) + level
        by_class = np.argsort(key, kind="stable")
        first = np.ones(len(rec), bool)
        first[by_class[1:]] = key[by_class[1:]] != key[by_class[:-1]]
        spared = np.concatenate([[0], np.cumsum(first & frequent)])
        inside = here & (place - (spared[:-1] - spared[begin]) < need)
        single |= inside & ~frequent
        at = np.flatnonzero(inside & frequent)
        at = at[np.argsort(key[at], kind="stable")]
        k, tag, x, d = key[at], g[at].astype(U) * U(0x2545F4914F6CDD1D), np.arange(len(at)), 1
        while len(x := x[x + d < len(at)]):
            x = x[k[x + d] == k[x]]
            out_s.append(mix(mix(h[at[x]]) * U(0x9E3779B97F4A7C15) + h[at[x + d]] + tag[x]))
            out_r.append(rec[at[x]])
            d += 1
    single &= df > 1
    return np.concatenate([*out_s, h[single]]), np.concatenate([*out_r, rec[single]])


def bitmaps(rec: np.ndarray, h: np.ndarray, records: int) -> np.ndarray:
    """Parity of the tokens that fall on each bit. Sets differ in at least as many tokens as bitmaps in bits."""
    parity = np.zeros((records, BITS), np.uint8)
    np.add.at(parity, (rec, (h % U(BITS)).astype(np.int64)), 1)
    return np.packbits(parity & 1, axis=1).view(U)


def near_pairs_in(sig: np.ndarray, who: np.ndarray, n: np.ndarray, bits: np.ndarray, threshold: float, all_pairs: int = ALL_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places that meet under a signature and pass the filters, for sorted signatures; third, the mask of
    the places in lists that were too long to try all pairs."""
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, len(sig)))
    long_ = np.repeat(sizes > all_pairs, sizes)
    end = np.repeat(begin + sizes, sizes)
    xs, ys = [], []

    def test(x: np.ndarray, y: np.ndarray) -> None:
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        ok = (small >= threshold * large - 1e-9) & (who[x] != who[y])
        x, y = x[ok], y[ok]
        both = n[x] + n[y]
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1).astype(np.int64)
        ok = (both - apart) // 2 >= np.ceil(threshold / (1 + threshold) * both - 1e-9)
        xs.append(x[ok])
        ys.append(y[ok])

    at, d = np.flatnonzero(~long_), 1
    while len(at := at[at + d < end[at]]):
        test(at, at + d)
        d += 1
    at = np.flatnonzero(long_)
    chain = at[at + 1 < end[at]]
    test(chain, chain + 1)
    head = np.repeat(begin, sizes)[at]
    test(head[head < at], at[head < at])
    return np.concatenate(xs), np.concatenate(ys), long_


PAIR = "kind int, sig long, a long, b long, n int, bits array<long>"


def candidates(batches: DataFrame, k: int, threshold: float, rare: int = RARE, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """Rows of kind 0, candidate pairs (a, b), and of kind 1, members a of a list ``sig`` that was too long."""
    chars = batches.agg(F.sum("size")).first()[0] or 0
    counting = ranges_for(chars / 8)

    def counted(payload: dict) -> tuple[np.ndarray, np.ndarray]:
        _, h = token_sets(payload["text"], k)
        return np.unique(short(h), return_counts=True)

    posting = max(8, int(chars * POSTINGS_A_CHAR / POSTINGS_A_RANGE) + 1)
    starts = range_starts(posting)

    def post(batch: int, payload: dict, answers: list) -> Iterator[pa.RecordBatch]:
        ids = np.array(payload["rep"], np.int64)
        rec, h = token_sets(payload["text"], k)
        if not len(rec):
            return
        u, at = np.unique(short(h), return_inverse=True)
        df = read_answers(answers, u, counting, True)[at].astype(np.int64)
        n, bits = np.bincount(rec, minlength=len(ids)), bitmaps(rec, h, len(ids))
        s, r = signatures(rec, h, df, threshold, rare)
        order = np.lexsort((r, s))
        s, r = s[order], r[order]
        ends = [*np.searchsorted(s, starts[1:]).tolist(), len(s)]
        a, ranges, blocks = 0, [], []
        for i, e in enumerate(ends):
            if e > a:
                held, local = np.unique(r[a:e], return_inverse=True)
                sigs = encode(s[a:e], local)
                table = np.column_stack([ids[held].astype(U), n[held].astype(U), bits[held]])
                ranges.append(i)
                blocks.append(len(sigs).to_bytes(4, "little") + sigs + table.tobytes())
            a = e
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blocks, pa.binary())], names=["range", "block"])

    def meet(group: pa.Table) -> pa.Table:
        sigs, whos, ns, bits = [], [], [], []
        for blob in group.column("block"):
            blob = blob.as_py()
            cut_ = int.from_bytes(blob[:4], "little") + 4
            s, local = decode(blob[4:cut_], True)
            table = np.frombuffer(blob, U, offset=cut_).reshape(-1, 2 + BITS // 64)[local]
            sigs.append(s)
            whos.append(table[:, 0].astype(np.int64))
            ns.append(table[:, 1].astype(np.int64))
            bits.append(table[:, 2:])
        sig, who, n, bit = np.concatenate(sigs), np.concatenate(whos), np.concatenate(ns), np.concatenate(bits)
        order = np.lexsort((who, sig))
        sig, who, n, bit = sig[order], who[order], n[order], bit[order]
        x, y, long_ = near_pairs_in(sig, who, n, bit, threshold, all_pairs)
        pairs = np.unique(np.column_stack([np.minimum(who[x], who[y]), np.maximum(who[x], who[y])]), axis=0)
        rest = np.flatnonzero(long_)
        m = len(pairs)
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1], [m, len(rest)]).astype(np.int32)),
                "sig": pa.array(np.concatenate([np.zeros(m, np.int64), sig[rest].view(np.int64)])),
                "a": pa.array(np.concatenate([pairs[:, 0], who[rest]])),
                "b": pa.array(np.concatenate([pairs[:, 1], who[rest]])),
                "n": pa.array(np.concatenate([np.zeros(m, np.int64), n[rest]]).astype(np.int32)),
                "bits": pa.array([None] * m + bit[rest].view(np.int64).tolist(), pa.list_(pa.int64())),
            }
        )

    posted = with_answers(batches, ask(batches, counted, counting, True), post, "range int, block binary")
    return cut(posted.groupBy("range").applyInArrow(meet, PAIR), "candidates")


def verified(pairs: DataFrame, batches: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts reach the threshold, compared by their shingles themselves."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codestrata.llm.census import unpack

        for b in parts:
            for blob in b.column("payload").to_pylist():
                p = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(p["rep"], pa.int64()), pa.array(p["text"], pa.string())], names=["rep", "text"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text: str) -> set:
            w = words_of(text)
            return set(zip(*(w[i:] for i in range(k))))

        for b in parts:
            keep = []
            for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist()):
                x, y = shingles(s), shingles(t)
                both = len(x & y)
                keep.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = cut(batches.select("payload").mapInArrow(rows, "rep long, text string").join(wanted, "rep", "left_semi"), "wanted")
    joined = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("t")), "b")
    return cut(joined.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long"), "links")


def _apart(listed: DataFrame, labels: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs that meet in a long list and are in different components, after the same filters.

    The members outside a list's largest component are rows, all members are columns; both are cut into blocks by hash, and a
    row and a column meet under the key (list, row block, column block), of at most about ``block`` of each."""
    held = listed.select("sig", "a", "n", "bits").join(labels.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    held = cut(held, "listed")
    parts = held.groupBy("sig", "component").agg(F.count("*").alias("m"))
    lists = parts.groupBy("sig").agg(F.sum("m").alias("m"), F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("inside")).where("inside < m")
    lists = lists.select("sig", "main", F.ceil((F.col("m") - F.col("inside")) / block).cast("int").alias("rows"), F.ceil(F.col("m") / block).cast("int").alias("columns"))
    x = cut(held.join(lists, "sig"), "open")
    of = lambda blocks, salt: F.pmod(F.xxhash64("a", F.lit(salt)), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    row = x.where("component <> main").withColumn("row", of("rows", 1)).withColumn("column", every("columns")).drop("rows", "columns")
    column = x.withColumn("column", of("columns", 2)).withColumn("row", every("rows")).select("sig", "row", "column", *(F.col(c).alias(f"{c}_2") for c in ("a", "n", "bits", "component")))
    apart = F.aggregate(F.zip_with("bits", "bits_2", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    need = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("n_2")) - 1e-9)
    fits = (F.least("n", "n_2") >= threshold * F.greatest("n", "n_2") - 1e-9) & (F.floor((F.col("n") + F.col("n_2") - apart) / 2) >= need)
    met = row.join(column, ["sig", "row", "column"]).where("component <> component_2 and (component_2 = main or a < a_2)").where(fits)
    return met.select(F.least("a", "a_2").alias("a"), F.greatest("a", "a_2").alias("b")).distinct()


def near_duplicates(records: DataFrame, shingle: int = 5, threshold: float = 0.8, least_words: int | None = None, rare: int = RARE, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(id, class_id, group_id) of records (id, text) with enough words: the smallest id with the same text and
    the smallest class of the group. Records alone in their group have a row as well."""
    least_words = max(shingle, least_words or shingle)
    keyed = records.where("id is not null").select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    distinct = keyed.groupBy("key", "text").agg(F.min("id").alias("rep"))
    enough = F.size(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))) >= least_words  # counted once for equal texts
    classes = cut(distinct.where(enough), "classes")
    members = keyed.select("id", "key").distinct().join(classes.select("key", "rep"), "key").select("id", F.col("rep").alias("class_id"))
    batches = pack_rows(classes.select("rep", "text"), lambda row: len(row[1]), BATCH_CHARS, "batches")
    tried = candidates(batches, shingle, threshold, rare, all_pairs)
    links = verified(tried.where("kind = 0").select("a", "b").distinct(), batches, shingle, threshold)
    labels = cut(connected_components(links), "groups")
    listed = tried.where("kind = 1")
    if listed.limit(1).count():
        more = cut(_apart(listed, labels, threshold), "apart")
        links = links.unionByName(verified(more, batches, shingle, threshold))
        labels = cut(connected_components(links), "groups")
    grouped = members.join(labels.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id", "left")
    return grouped.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))


def pairs_in_groups(groups: DataFrame) -> DataFrame:
    """(a, b) of all pairs of records of the same group, a < b. Grows with the square of a group."""
    x, y = groups.select("group_id", F.col("id").alias("a")), groups.select("group_id", F.col("id").alias("b"))
    several = groups.groupBy("group_id").agg(F.count("*").alias("m")).where("m > 1").select("group_id")
    return x.join(several, "group_id", "left_semi").join(y, "group_id").where("a < b").select("a", "b")
