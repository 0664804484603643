"""Problem 2: near-duplicate records with small edits, by Jaccard similarity of word shingles.

Method: adaptive multi-match prefixes. The distinct shingles of a record are put in one global order, rare ones
first (frequencies from a hashed counter over all records). Two records as similar as the threshold demands share
at least l of the first ``n - ceil(t n) + l`` shingles of both, for any l. Each record picks the l that minimises
its estimated cost: the postings its prefix meets, plus verification of the candidates that meet it l times. A
pair becomes a candidate only if it meets at least min(l_a, l_b) times; candidates are then verified exactly.

What keeps it scalable:

* Exact copies (equal shingle sets) are one class with one representative; only representatives are joined.
* Postings travel as packed arrays per token partition, not as rows. A pair met in a partition must pass the
  size bound, the positional bound and a comparison of 128 one-bit minhashes before it is emitted at all; a pair
  at the threshold fails that comparison with a probability under 1e-9 (80 of 128 equal bits, 109 expected).
* A token that very many prefixes hold is split into blocks; each pair of blocks is a cell of its own, so no
  task gets an unbounded list, and every pair of its holders still meets in exactly one cell.
* Only the records of candidate pairs are read again for verification.

Defined results: null, empty and short texts (fewer than ``min_words`` words) have no class and no partner; a
record is never paired with itself; records with a null key are left out; repeated rows of a key are one record.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.runtime import checkpoint, default_parallelism, small, spread

SHINGLE, THRESHOLD, MIN_WORDS = 5, 0.8, 30
COUNTERS, BLOCKS = 1 << 21, 64
HASHES, EQUAL_BITS = 128, 80
#: Cost of verifying a candidate, in postings scanned, and the largest number of matches asked for.
VERIFY_COST, MOST_MATCHES = 24.0, 16
#: Holders of a token beyond which it is split, and holders in a block.
HOT, BLOCK = 4000, 2000
#: Postings in a token partition, and the classes of copies up to which pairs() writes all pairs.
POSTINGS, EXPAND = 1_500_000, 100

_WORDS = re.compile(r"[^\W_]+").findall
_ODD = (np.random.default_rng(20240229).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    def __init__(self, k: int, min_words: int):
        self.k, self.min_words, self.known = k, min_words, {}
        self.factors = _mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The sorted hashes of the distinct shingles, or None if the text has too few words."""
        words = _WORDS(text.lower()) if text else []
        if len(words) < max(self.min_words, self.k):
            return None
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.k + 1
        s = h[:n] * self.factors[0]
        for i in range(1, self.k):
            s += h[i : i + n] * self.factors[i]
        return np.unique(_mix(s))


def sketch(s: np.ndarray) -> np.ndarray:
    """128 one-bit minhashes as two words."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = (low[:, None] * _ODD[None, :]).min(axis=0)
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(17)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _survey(df: DataFrame, k: int, min_words: int) -> DataFrame:
    """Of every record its set's signature and size (kind 0), and of every task its counters of shingles (kind 1)."""

    def run(batches):
        shingles, counts = Shingler(k, min_words), np.zeros(COUNTERS, np.int32)
        for b in batches:
            key, one, two, size, found = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (s := shingles(t)) is None:
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                key.append(i), one.append((d >> 64) - (1 << 63)), two.append((d & ((1 << 64) - 1)) - (1 << 63)), size.append(len(s)), found.append(s)
            if found:
                counts += np.bincount((np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(key), pa.int32()), pa.array(key, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int32()), pa.nulls(len(key), pa.binary())], names=names)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, BLOCKS)]
            zero = pa.array([0] * BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int64()), zero, zero, zero.cast(pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["kind", "key", "one", "two", "size", "blob"]
    return df.mapInArrow(run, "kind int, key bigint, one bigint, two bigint, size int, blob binary")


def _frequencies(survey: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up: COUNTERS numbers, whatever the input's size."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1) for x in total.values()], pa.binary())], names=["key", "blob"])

    counts = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int32)
    for r in survey.filter("kind = 1").select("key", "blob").repartition(8, "key").mapInArrow(add, "key bigint, blob binary").collect():
        counts[r["key"]] = np.frombuffer(zlib.decompress(r["blob"]), np.int32)
    return counts.reshape(-1)


def matches_to_ask(freq: np.ndarray, n: int, least: int) -> int:
    """The l with the lowest estimated cost; ``freq`` are the frequencies in prefix order."""
    met = np.cumsum(freq[: n - least + MOST_MATCHES])
    most = min(MOST_MATCHES, least)
    ask = np.arange(1, most + 1)
    at = met[np.minimum(n - least + ask, len(met)) - 1]
    return int(ask[np.argmin(at + VERIFY_COST * at / ask)])


def _postings(df: DataFrame, counts, parts: int, k: int, threshold: float, min_words: int) -> DataFrame:
    """(part, blob): the prefix postings of a batch of records that fall into a token partition, packed."""

    def run(batches):
        shingles, freq = Shingler(k, min_words), counts.value
        noise = float(freq.mean())
        for b in batches:
            keys, sizes, asks, marks = [], [], [], []
            token, owner, place, side = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (s := shingles(t)) is None:
                    continue
                f = freq[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((s, f))
                n, least = len(s), math.ceil(threshold * len(s) - 1e-9)
                s, f = s[order], np.maximum(f[order] - noise, 1.0)
                ask = matches_to_ask(f, n, least)
                p = n - least + ask
                at = len(keys)
                keys.append(i), sizes.append(n), asks.append(ask), marks.append(sketch(s))
                tok, pos = s[:p], np.arange(p, dtype=np.int32)
                sd = np.zeros(p, np.int8)
                if (hot := f[:p] > HOT).any():
                    more_t, more_p, more_s = [tok[~hot]], [pos[~hot]], [sd[~hot]]
                    for h in np.flatnonzero(hot):
                        blocks = int(f[h] // BLOCK) + 1
                        mine = int(_mix(np.array([i], np.int64).view(np.uint64) ^ tok[h])[0] % np.uint64(blocks))
                        other = np.arange(blocks, dtype=np.uint64)
                        cell = np.minimum(other, mine) * np.uint64(blocks) + np.maximum(other, mine)
                        more_t.append(_mix(tok[h] + (cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
                        more_p.append(np.full(blocks, pos[h], np.int32))
                        more_s.append(np.where(other == mine, 0, np.where(other > mine, 1, 2)).astype(np.int8))
                    tok, pos, sd = map(np.concatenate, (more_t, more_p, more_s))
                token.append(tok), place.append(pos), side.append(sd), owner.append(np.full(len(tok), at, np.int32))
            if not keys:
                continue
            token, owner, place, side = map(np.concatenate, (token, owner, place, side))
            part = (token >> np.uint64(24)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            token, owner, place, side, part = (x[order] for x in (token, owner, place, side, part.astype(np.int32)))
            edges = np.flatnonzero(np.diff(part)) + 1
            keys, sizes, asks, marks = np.array(keys, np.int64), np.array(sizes, np.int32), np.array(asks, np.int8), np.array(marks, np.uint64)
            out_part, out = [], []
            for lo, hi in zip([0, *edges], [*edges, len(part)]):
                docs, back = np.unique(owner[lo:hi], return_inverse=True)
                head = np.array([len(docs), hi - lo], np.int64)
                out_part.append(int(part[lo]))
                out.append(b"".join(x.tobytes() for x in (head, keys[docs], marks[docs], token[lo:hi], sizes[docs], back.astype(np.int32), place[lo:hi], asks[docs], side[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out, pa.binary())], names=["part", "blob"])

    return df.mapInArrow(run, "part int, blob binary")


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[] for _ in range(8)]
    base = 0
    for blob in blobs:
        d, p = np.frombuffer(blob, np.int64, 2)
        at = 16
        for j, (kind, n, width) in enumerate([(np.int64, d, 1), (np.uint64, d, 2), (np.uint64, p, 1), (np.int32, d, 1), (np.int32, p, 1), (np.int32, p, 1), (np.int8, d, 1), (np.int8, p, 1)]):
            x = np.frombuffer(blob, kind, n * width, at)
            at += x.nbytes
            cols[j].append(x + base if j == 4 else x.reshape(-1, 2) if width == 2 else x)
        base += int(d)
    return [np.concatenate(c) for c in cols]


def meet(blobs: list[bytes], threshold: float) -> tuple[np.ndarray, ...]:
    """(a, b, times met, matches asked for) of the pairs of one token partition that pass the bounds."""
    keys, marks, token, sizes, owner, place, asks, side = _unpack(blobs)
    order = np.argsort(token, kind="stable")
    token, owner, place, side = token[order], owner[order], place[order], side[order]
    share, found = threshold / (1 + threshold), []
    n = len(token)
    at, step = np.arange(n - 1), 1
    while len(at := at[at + step < n]) and len(at := at[token[at] == token[at + step]]):
        for lo in range(0, len(at), 2_000_000):
            i = at[lo : lo + 2_000_000]
            j = i + step
            keep = (side[i] == 0) & (side[j] == 0) | (side[i] + side[j] == 3)
            i, j = i[keep], j[keep]
            a, b = owner[i], owner[j]
            na, nb, pa_, pb = sizes[a], sizes[b], place[i], place[j]
            ok = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-6
            ok &= np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1 >= share * (na + nb) - 1e-6
            a, b = a[ok], b[ok]
            ok = HASHES - np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1) >= EQUAL_BITS
            found.append(np.stack([a[ok], b[ok]]))
        step += 1
    if not found:
        return tuple(np.array([], np.int64) for _ in range(4))
    a, b = np.concatenate(found, axis=1).astype(np.int64)
    ask = np.minimum(asks[a], asks[b]).astype(np.int64)
    ka, kb = keys[a], keys[b]
    ka, kb = np.minimum(ka, kb), np.maximum(ka, kb)
    keep = ka != kb
    ka, kb, ask = ka[keep], kb[keep], ask[keep]
    o = np.lexsort((kb, ka))
    ka, kb, ask = ka[o], kb[o], ask[o]
    first = np.flatnonzero(np.r_[True, (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])][: len(ka)])
    return ka[first], kb[first], np.diff(np.r_[first, len(ka)]), ask[first]


def _candidates(postings: DataFrame, threshold: float) -> DataFrame:
    def run(_, table):
        a, b, met, ask = meet(table.column("blob").to_pylist(), threshold)
        return pa.table({"a": a, "b": b, "met": met, "ask": ask})

    pairs = postings.groupBy("part").applyInArrow(run, "a bigint, b bigint, met bigint, ask bigint")
    return pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("ask").alias("ask")).filter("met >= ask").select("a", "b")


def _sets(df: DataFrame, k: int, min_words: int) -> DataFrame:
    def run(batches):
        shingles = Shingler(k, min_words)
        for b in batches:
            sets = [(i, s.tobytes()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (s := shingles(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.binary())], names=["key", "set"])

    return df.mapInArrow(run, "key bigint, set binary")


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    both = candidates.join(sets.withColumnsRenamed({"key": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"key": "b", "set": "sb"}), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for t in batches:
            share = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                m = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                share.append(m / (len(x) + len(y) - m))
            share = np.array(share, float)
            ok = pa.array(share >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok), pa.array(share).filter(ok)], names=["a", "b", "similarity"])

    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_classes(df: DataFrame, key: str = "rec_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Membership ``(key, class_id)`` of every record with enough words, the class being that of its exact copies and
    named by their least key; and the pairs ``(a, b, similarity)`` of different classes over the threshold, a < b."""
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null and text is not null")
    docs = spread(docs, "key")
    survey = checkpoint(_survey(docs, k, min_words))
    sets = survey.filter("kind = 0").select("key", "one", "two", "size")
    names = sets.groupBy("one", "two").agg(F.min("key").alias("class_id"), F.count("*").alias("n"))
    total = sets.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    copied = names.filter("n > 1").drop("n")
    extra = checkpoint(sets.join(copied, ["one", "two"]).filter("key != class_id").select("key", "class_id").distinct())
    members = sets.select("key").distinct().join(small(extra), "key", "left").select("key", F.coalesce("class_id", "key").alias("class_id"))
    if not total["n"]:
        return members, df.sparkSession.createDataFrame([], "a bigint, b bigint, similarity double")
    counts = df.sparkSession.sparkContext.broadcast(_frequencies(survey))
    expected = (1 - threshold) * total["s"] + 8 * total["n"]
    parts = max(2 * default_parallelism(df), math.ceil(expected / POSTINGS))
    single = docs.join(small(extra.select("key")), "key", "left_anti")
    found = checkpoint(_candidates(_postings(single.select("key", "text"), counts, parts, k, threshold, min_words), threshold))
    needed = checkpoint(found.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    again = _sets(docs.join(small(needed), "key", "left_semi").dropDuplicates(["key"]).select("key", "text"), k, min_words)
    return members, _verified(found, again, threshold)


def pairs(members: DataFrame, links: DataFrame, key: str = "rec_id", expand: int = EXPAND) -> DataFrame:
    """``(rec_a, rec_b)`` of the similar records. Classes of up to ``expand`` exact copies are written as all their
    pairs; larger ones as the pairs of their representative with each copy and with the other classes, which keeps
    every link between different texts and grows in proportion to the copies."""
    members = checkpoint(members)
    n = members.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1")
    spread = checkpoint(members.join(n, "class_id").filter((F.col("n") <= expand) | (F.col("key") == F.col("class_id"))).select("key", "class_id", "n"))
    large = members.join(n.filter(F.col("n") > expand), "class_id").filter("key != class_id").select(F.col("class_id").alias("a"), F.col("key").alias("b"))
    x, y = (spread.select(F.col("key").alias(c), F.col("class_id")) for c in "ab")
    inside = x.join(y, "class_id").filter("a < b").select("a", "b")
    ends = spread.select(F.col("class_id").alias("c"), F.col("key").alias("m"))
    across = links.select("a", "b")
    for side in "ab":
        across = across.join(ends, across[side] == ends["c"], "left").withColumn(side, F.coalesce("m", side)).drop("c", "m")
    every = across.unionByName(inside).unionByName(large)
    return every.select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(v, l)``: of every vertex of the edges (a, b) the least one that it is connected with.

    Large and small stars in turn: each vertex hands its larger neighbours, then its smaller ones, to the least of all.
    A long chain folds up by about half in a round; it ends when every edge leads to a centre and no centre leads on.
    Each round's state is a checkpoint, and nothing but a count reaches the driver.
    """
    star = checkpoint(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).filter("v != w").distinct())
    while True:
        both = star.union(star.select("w", "v"))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("m"))
        large = both.join(least, "v").filter("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).distinct()
        low = large.groupBy("v").agg(F.min("w").alias("m"))
        rest = large.join(low, "v").filter("w != m").select(F.col("w").alias("v"), "m")
        star = checkpoint(rest.union(low).distinct().toDF("v", "w"))
        ends = star.select("v", F.lit(1).alias("up"), F.lit(0).alias("down")).union(star.select("w", F.lit(0), F.lit(1)))
        if not ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").limit(1).count():
            return star.select("v", F.col("w").alias("l")).union(star.select("w", "w")).distinct()


def groups(members: DataFrame, links: DataFrame, key: str = "rec_id") -> DataFrame:
    """``(key, class_id, group_id, n_links)``: groups are the connected components of the links between classes, named
    by their least key; ``n_links`` counts the different texts a record's text is linked with."""
    links = checkpoint(links.select("a", "b"))
    both = links.union(links.select("b", "a")).toDF("v", "w")
    label = components(links)
    degree = both.groupBy("v").agg(F.count("*").alias("n_links"))
    out = members.join(label, members["class_id"] == label["v"], "left").drop("v").join(degree, members["class_id"] == degree["v"], "left")
    return out.select(F.col("key").alias(key), "class_id", F.coalesce("l", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
