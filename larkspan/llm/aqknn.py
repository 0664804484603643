"""Problem 1: the k most similar vectors of every vector, by additive quantisation.

Method: full-dimensional codebooks are trained on residuals, level after level, from a bounded sample. Every vector
is encoded by beam search as a sum of one codeword per level; its norm after decoding is kept with the codebooks'
lookup tables. The beams of the first levels name the cells a vector is filed under (several, so that two similar
vectors share one even when they lie across a border). Within a cell, each vector's table of products with all
codewords scores the codes of all others by lookups; pairs whose approximate cosine comes near the threshold are
reranked exactly from the original vectors.

What keeps it scalable: exact copies are one class and only its first vector is searched; cells are picked deeper as
the collection grows, so their size stays level, and cells that the sample shows to be crowded are opened further; one
that can't be opened is searched by blocks of its members, each block a task's work of its own; codes travel as packed arrays, vectors only for pairs that pass the lookup; the codebooks (256 KB) and the sample
(``SAMPLE`` vectors) have a fixed size.

Defined results: null vectors, vectors of another length, with a null, NaN or infinite number, or all zero are not
usable: they have no neighbours and are nobody's neighbour. Equal vectors are neighbours with cosine 1. Ties go to
the smaller key. Repeated rows of a key count once. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.neardup import components
from larkspan.runtime import checkpoint, default_parallelism, small, spread

K, MIN_COSINE, DIMENSIONS = 5, 0.90, 64
#: The sample that codebooks are fitted on, codewords of a level, levels, rounds of k-means.
SAMPLE, WORDS, LEVELS, ROUNDS = 8192, 64, 16, 6
#: Cells a vector is filed under when cells are named by 1, 2, 3, ... levels, and beam beyond the named levels.
PROBES, BEAM = (3, 5, 8, 12), 2
#: Vectors in a cell aimed at on average, and estimated size from which a cell is opened further.
CELL, CROWDED = 600, 6000
#: Candidates of a vector in a cell up to which lookups decide; a vector with more is compared exactly with the cell.
SHORTLIST = 32
#: How far below the threshold an approximate cosine may lie.
SLACK = 0.22
#: Vectors of a block in exact comparison.
BLOCK = 8192


def usable(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and the vectors themselves."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dimensions)
    if not n or not len(at):
        return at[:0], np.zeros((0, dimensions), np.float32)
    flat = column.filter(pa.array(lengths == dimensions)).flatten()
    x = np.asarray(flat.cast(pa.float32()).to_numpy(zero_copy_only=False)).reshape(-1, dimensions)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def train(x: np.ndarray) -> np.ndarray:
    """Codebooks (level, word, dimension), each fitted to what the levels before leave over."""
    rng, rest, books = np.random.default_rng(7), x.astype(np.float32), []
    for _ in range(LEVELS):
        c = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)].copy()
        for _ in range(ROUNDS):
            near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
            hot = np.zeros((WORDS, len(rest)), np.float32)
            hot[near, np.arange(len(rest))] = 1
            n = hot.sum(1)
            c = np.where(n[:, None] > 0, hot @ rest / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), WORDS)])
        c = c.astype(np.float32)
        books.append(c)
        rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)]
    return np.stack(books)


class Codec:
    def __init__(self, books: np.ndarray, depth: int, closed: frozenset[int] = frozenset(), crowds: dict[int, int] | None = None):
        self.books, self.depth, self.closed, self.crowds = books, depth, closed, crowds or {}
        self.levels, self.words, d = books.shape
        self.flat = books.reshape(-1, d)
        gram = 2 * self.flat @ self.flat.T
        w = self.words
        self.cross = [[np.ascontiguousarray(gram[j * w : (j + 1) * w, m * w : (m + 1) * w]) for m in range(self.levels)] for j in range(self.levels)]
        self.own = [(b * b).sum(1) for b in books]
        self.deepest = max([depth, *(self.level_of(c) + 1 for c in closed)])

    def level_of(self, cell: int) -> int:
        return (cell.bit_length() - 1) // 6

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Codes (n, levels) of the best beam, and by depth the names (n, probes) of the cells in the beam there."""
        n, w = len(x), self.words
        dots = -2 * (x @ self.flat.T)
        cost = np.zeros((n, 1), np.float32)
        codes: list[np.ndarray] = []
        name = np.ones((n, 1), np.int64)
        cells: dict[int, np.ndarray] = {}
        rows = np.arange(n)[:, None]
        for m in range(self.levels):
            step = dots[:, None, m * w : (m + 1) * w] + self.own[m]
            total = np.repeat(step, cost.shape[1], axis=1) + cost[:, :, None]
            for j, c in enumerate(codes):
                total += self.cross[j][m][c]
            total = total.reshape(n, -1)
            beam = PROBES[min(m, len(PROBES) - 1)] if m + 1 <= self.deepest else BEAM
            if m + 1 < self.deepest:
                beam = max(beam, PROBES[min(self.deepest, len(PROBES)) - 1])
            if m == self.levels - 1:
                beam = 1
            if beam <= 2:
                top = [total.argmin(axis=1)]
                if beam == 2:
                    masked = total.copy()
                    masked[rows[:, 0], top[0]] = np.inf
                    top.append(masked.argmin(axis=1))
                top = np.stack(top, axis=1)
            else:
                top = np.argpartition(total, beam - 1, axis=1)[:, :beam]
                top = top[rows, np.argsort(total[rows, top], axis=1, kind="stable")]
            cost = total[rows, top]
            parent, word = top // w, top % w
            codes = [c[rows, parent] for c in codes] + [word]
            if m < self.deepest:
                name = name[rows, parent] * w + word
                if m + 1 >= self.depth:
                    cells[m + 1] = name[:, : PROBES[min(m, len(PROBES) - 1)]]
        return np.stack([c[:, 0] for c in codes], axis=1).astype(np.uint8), cells

    def filed(self, cells: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): each cell of the named depth, and instead of a closed cell those below it."""
        shut = np.array(sorted(self.closed), np.int64)
        rows, names = [], []
        for depth, c in cells.items():
            keep = ~np.isin(c, shut) if len(shut) else np.ones(c.shape, bool)
            if depth > self.depth:
                keep &= np.isin(c // self.words, shut)
            r, p = np.nonzero(keep)
            rows.append(r), names.append(c[r, p])
        return np.concatenate(rows), np.concatenate(names)

    def blocked(self, keys: np.ndarray, rows: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, asking): a crowd becomes one cell for each block of its members, who ask in their own and are
        there to be found in all."""
        asking = np.ones(len(rows), np.int8)
        for cell, n in self.crowds.items():
            at = np.flatnonzero(names == cell)
            if not len(at):
                continue
            mine = (keys[rows[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(n)
            block = np.tile(np.arange(n), len(at))
            rest = np.delete(np.arange(len(rows)), at)
            # names of blocks are negative: no cell has such a name
            new = -(np.int64(cell) * n + block) - 1
            r = np.repeat(rows[at], n)
            rows, names, asking = np.r_[rows[rest], r], np.r_[names[rest], new], np.r_[asking[rest], (block == np.repeat(mine, n)).astype(np.int8)]
        return rows, names, asking

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.books[0][codes[:, 0]].copy()
        for m in range(1, self.levels):
            out += self.books[m][codes[:, m]]
        return out

    def near(self, codes: np.ndarray, asking: np.ndarray, least: float, full: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of the coded vectors with an approximate cosine of at least ``least``, i asking, by table
        lookups. With ``full``, each i with more than SHORTLIST of them goes there instead: lookups can't tell them apart."""
        out_i, out_j = [], []
        decoded = self.decode(codes)
        norm = np.maximum(np.linalg.norm(decoded, axis=1), 1e-9)
        at = codes.astype(np.intp) + np.arange(self.levels) * self.words
        asks = np.flatnonzero(asking)
        for lo in range(0, len(asks), 512):
            who = asks[lo : lo + 512]
            tables = ((decoded[who] / norm[who, None]) @ self.flat.T).T.copy()  # (level and word, query)
            found = []
            for start in range(0, len(codes), 4096):
                other = at[start : start + 4096]
                score = tables[other[:, 0]]
                for m in range(1, self.levels):
                    score += tables[other[:, m]]
                score /= norm[start : start + 4096, None]
                j, i = np.nonzero(score >= least)
                keep = j + start != who[i]
                found.append((i[keep], j[keep] + start))
            i, j = (np.concatenate(x) for x in zip(*found))
            if full is not None:
                many = np.bincount(i, minlength=len(who)) > SHORTLIST
                full.append(who[many])
                i, j = i[~many[i]], j[~many[i]]
            out_i.append(who[i]), out_j.append(j)
        if not out_i:
            return np.array([], np.int64), np.array([], np.int64)
        return np.concatenate(out_i), np.concatenate(out_j)


def plan_depth(n: int) -> int:
    depth = 1
    while depth < LEVELS - 1 and n * PROBES[min(depth, len(PROBES)) - 1] / WORDS**depth > CELL:
        depth += 1
    return depth


def plan(books: np.ndarray, sample: np.ndarray, n: int) -> Codec:
    """The codec for ``n`` vectors: cells of the depth that keeps them level, crowded ones (by the sample) opened, and
    blocks for those that stay crowded."""
    codec = Codec(books, plan_depth(n))
    scale = n / max(len(sample), 1)
    for _ in range(5):
        _, name = codec.filed(codec.encode(sample)[1])
        cells, seen = np.unique(name, return_counts=True)
        crowds = {int(c): int(k * scale) for c, k in zip(cells, seen) if k * scale > CROWDED and n > CROWDED}
        open_ = frozenset(c for c in crowds if codec.level_of(c) < codec.depth + 3)
        if not open_:
            codec.crowds = {c: k // (CROWDED // 2) + 1 for c, k in crowds.items()}
            break
        codec = Codec(books, codec.depth, codec.closed | open_)
    return codec


def _survey(df: DataFrame, dimensions: int) -> DataFrame:
    def run(batches):
        for b in batches:
            at, x = usable(b.column(1), dimensions)
            d = [xxhash.xxh3_128_intdigest(r.tobytes()) for r in x + np.float32(0)]  # -0.0 is 0.0
            one, two = [(v >> 64) - (1 << 63) for v in d], [(v & ((1 << 64) - 1)) - (1 << 63) for v in d]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["key", "one", "two"])

    return df.mapInArrow(run, "key bigint, one bigint, two bigint")


def _codes(df: DataFrame, codec, dimensions: int, parts: int) -> DataFrame:
    """(part, blob): the codes filed under the cells of a partition of cells, packed."""

    def run(batches):
        for b in batches:
            at, x = usable(b.column(1), dimensions)
            if not len(at):
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            codes, rows, names = [], [], []
            for lo in range(0, len(x), 1024):
                c, cells = codec.value.encode(unit(x[lo : lo + 1024]))
                r, name = codec.value.filed(cells)
                codes.append(c), rows.append(r + lo), names.append(name)
            codes, rows, names = map(np.concatenate, (codes, rows, names))
            rows, names, asking = codec.value.blocked(keys, rows, names)
            part = (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            o = np.argsort(part, kind="stable")
            part, rows, names, asking = part[o].astype(np.int32), rows[o], names[o], asking[o]
            edges = np.flatnonzero(np.diff(part)) + 1
            where, blobs = [], []
            for lo, hi in zip([0, *edges], [*edges, len(part)]):
                where.append(int(part[lo]))
                blobs.append(np.array([hi - lo], np.int64).tobytes() + names[lo:hi].tobytes() + keys[rows[lo:hi]].tobytes() + codes[rows[lo:hi]].tobytes() + asking[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return df.mapInArrow(run, "part int, blob binary")


def _near(coded: DataFrame, codec, least: float) -> DataFrame:
    """Pairs (a, b) that pass the lookup; and of each cell where some vector has too many of them the members, as a,
    with the cell and whether this one has. Cells are null in pairs."""

    def run(_, table):
        names, keys, codes, asking = [], [], [], []
        for blob in table.column("blob").to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            names.append(np.frombuffer(blob, np.int64, n, 8)), keys.append(np.frombuffer(blob, np.int64, n, 8 + 8 * n))
            codes.append(np.frombuffer(blob, np.uint8, n * LEVELS, 8 + 16 * n).reshape(n, LEVELS)), asking.append(np.frombuffer(blob, np.int8, n, 8 + (16 + LEVELS) * n))
        names, keys, codes, asking = map(np.concatenate, (names, keys, codes, asking))
        o = np.argsort(names, kind="stable")
        names, keys, codes, asking = names[o], keys[o], codes[o], asking[o]
        edges = np.flatnonzero(np.diff(names)) + 1
        a, b = [np.array([], np.int64)], [np.array([], np.int64)]
        member, cell, ask = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.int8)]
        blocks = {-(c * n + i) - 1: c for c, n in codec.value.crowds.items() for i in range(n)}
        for lo, hi in zip([0, *edges], [*edges, len(names)]):
            if hi - lo > 1:
                full: list = []
                i, j = codec.value.near(codes[lo:hi], asking[lo:hi], least, full)
                a.append(keys[lo + i]), b.append(keys[lo + j])
                name = int(names[lo])
                if name in blocks or sum(map(len, full)):
                    # the blocks of a crowd hand in their own members, so that the crowd is one cell again
                    is_full = np.zeros(hi - lo, np.int8)
                    is_full[np.concatenate([np.array([], np.int64), *full])] = 1
                    own = np.flatnonzero(asking[lo:hi])
                    member.append(keys[lo + own]), ask.append(is_full[own]), cell.append(np.full(len(own), blocks.get(name, name)))
        a, b, member, cell, ask = map(np.concatenate, (a, b, member, cell, ask))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        none = pa.nulls(len(both), pa.int64())
        return pa.table(
            {
                "a": np.r_[both[:, 0], member],
                "b": pa.concat_arrays([pa.array(both[:, 1]), pa.nulls(len(member), pa.int64())]),
                "cell": pa.concat_arrays([none, pa.array(cell)]),
                "ask": pa.concat_arrays([none.cast(pa.int8()), pa.array(ask)]),
            }
        )

    return coded.groupBy("part").applyInArrow(run, "a bigint, b bigint, cell bigint, ask tinyint").distinct()


def _reranked(found: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    both = found.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.asarray(t.column(i).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1) for i in (2, 3))
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            ok = pa.array(cosine >= least)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok), pa.array(cosine).filter(ok)], names=["a", "b", "cosine"])

    return both.mapInArrow(run, "a bigint, b bigint, cosine double")


def _compared(members: DataFrame, vectors: DataFrame, k: int, least: float, dimensions: int) -> DataFrame:
    """Pairs (a, b) of the members ``(cell, key, ask)`` of a cell: of each that asks, the k + 1 others with the highest
    exact cosine. Blocks of a cell meet each other in tasks of their own, so a task's size is bounded."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    placed = members.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("key"), "n").cast("int")).join(vectors, "key")
    each = F.sequence(F.lit(0), F.col("n") - 1)
    asking = placed.filter("ask = 1").select("cell", F.col("mine").alias("q"), F.explode(each).alias("t"), F.lit(1).alias("ask"), "key", "v")
    there = placed.select("cell", F.explode(each).alias("q"), F.col("mine").alias("t"), F.lit(0).alias("ask"), "key", "v")

    def run(_, table):
        at, x = usable(table.column("v"), dimensions)
        ask, keys = (table.column(c).to_numpy()[at] for c in ("ask", "key"))
        x = x.astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = np.argsort(keys, kind="stable")
        o = o[ask[o] == 0]
        others, y = keys[o], x[o]
        asks, x = keys[ask == 1], x[ask == 1]
        out = [[np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.float64)]]
        for lo in range(0, len(asks) if len(others) else 0, 512):
            who = asks[lo : lo + 512]
            score = x[lo : lo + 512] @ y.T
            own = np.minimum(np.searchsorted(others, who), len(others) - 1)
            own, itself = own[others[own] == who], np.flatnonzero(others[own] == who)
            score[itself, own] = -np.inf
            last = np.full(len(who), -np.inf)
            if len(others) > k + 1:
                last = np.partition(score, len(others) - k - 1, axis=1)[:, len(others) - k - 1]
            i, j = np.nonzero(score >= np.maximum(last - 1e-12, least - 1e-9)[:, None])
            v = np.round(score[i, j], 12)
            o = np.lexsort((j, -v, i))
            i, j, v = i[o], j[o], v[o]
            keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
            out[0].append(who[i[keep]]), out[1].append(others[j[keep]]), out[2].append(v[keep])
        return pa.table(dict(zip("abv", map(np.concatenate, out))))

    best = asking.union(there).groupBy("cell", "q", "t").applyInArrow(run, "a bigint, b bigint, v double").distinct()
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))).filter(F.col("n") <= k + 1)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nearest(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = K, least: float | None = MIN_COSINE, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, neighbour, rank, cosine)``: of every usable vector the at most ``k`` others with the highest cosine, of at
    least ``least``. Without ``least`` every vector has its ``k`` nearest, however far they are: codes and cells can't
    rule out anything then, and all are compared exactly, which takes time by the square of the vectors."""
    if k < 1:
        raise ValueError("k must be at least 1")
    base = df.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<float>").alias("v")).filter("key is not null and v is not null")
    base = spread(base, "key")
    survey = checkpoint(_survey(base, dimensions))
    names = survey.groupBy("one", "two").agg(F.min("key").alias("c"), F.count_distinct("key").alias("n"))
    copied = names.filter("n > 1")
    copies = checkpoint(survey.join(copied, ["one", "two"]).select("c", "key").distinct())
    n = survey.count()
    extra = copies.filter("c != key").select("key")
    single = base.join(small(extra), "key", "left_anti").select("key", "v")
    schema = "a bigint, b bigint, cosine double"
    if n and least is None:
        members = survey.select("key").distinct().join(small(extra), "key", "left_anti").select(F.lit(0).cast("long").alias("cell"), "key", F.lit(1).alias("ask"))
        vectors = single.dropDuplicates(["key"])
        links = _reranked(checkpoint(_compared(members, vectors, k, -2.0, dimensions)), vectors, -2.0)
        return _spread(links, copies, k).select(F.col("key").alias(key), "neighbour", "rank", "cosine")
    if n:
        share = min(1.0, 1.2 * SAMPLE / n)
        picked = base.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key", "v").limit(2 * SAMPLE).toArrow()
        sample = unit(usable(picked.column("v"), dimensions)[1])
    if not n or not len(sample):
        links = df.sparkSession.createDataFrame([], schema)
    else:
        codec = df.sparkSession.sparkContext.broadcast(plan(train(sample), sample, n))
        parts = max(2 * default_parallelism(df), math.ceil(n * 8 / 200_000))
        near = checkpoint(_near(_codes(single, codec, dimensions, parts), codec, least - SLACK))
        found = near.filter("cell is null").select("a", "b")
        full = near.filter("ask = 1").select("cell").distinct()
        if full.limit(1).count():
            # a crowd lies across several cells: those that a vector with too many candidates is filed under are one
            members = checkpoint(near.join(small(full), "cell", "left_semi").select("cell", F.col("a").alias("key"), "ask"))
            joined = members.groupBy("key").agg(F.min("cell").alias("a"), F.collect_set("cell").alias("cells"), F.max("ask").alias("ask")).filter("ask = 1")
            crowd = components(joined.select("a", F.explode("cells").alias("b")).filter("a != b").distinct()).toDF("cell", "crowd")
            members = members.join(small(checkpoint(crowd)), "cell", "left").groupBy(F.coalesce("crowd", "cell").alias("cell"), "key").agg(F.max("ask").alias("ask"))
            inside = members.select("key").distinct()
            met = _compared(members, base.join(small(inside), "key", "left_semi").dropDuplicates(["key"]).select("key", "v"), k, least, dimensions)
            found = checkpoint(found.union(met).distinct())
        needed = checkpoint(found.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        vectors = base.join(small(needed), "key", "left_semi").dropDuplicates(["key"]).select("key", "v")
        links = _reranked(found, vectors, least)
    return _spread(links, copies, k).select(F.col("key").alias(key), "neighbour", "rank", "cosine")


def _spread(links: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """From links between classes to neighbours of vectors. A class offers its first k + 1 members, which is enough
    for anyone; every member then takes the first k of its class's list but itself: work in proportion to the members."""
    order = lambda p: Window.partitionBy(p).orderBy(F.desc("cosine"), "o")
    heads = copies.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("key"))).filter(F.col("n") <= k + 1).select("c", F.col("key").alias("o"))
    both = links.select("a", "b", "cosine").union(links.select("b", "a", "cosine")).toDF("c", "to", "cosine")
    # more than k + 1 classes can't be of use to a class
    both = both.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cosine"), "to"))).filter(F.col("n") <= k + 1).drop("n")
    offered = both.join(heads.withColumnRenamed("c", "to"), "to", "left").select("c", F.coalesce("o", "to").alias("o"), "cosine")
    lists = offered.unionByName(heads.withColumn("cosine", F.lit(1.0)))
    lists = lists.withColumn("n", F.row_number().over(order("c"))).filter(F.col("n") <= k + 1).drop("n")
    each = lists.join(copies, "c", "left").select(F.coalesce("key", "c").alias("key"), "o", "cosine").filter("key != o")
    return each.withColumn("rank", F.row_number().over(order("key"))).filter(F.col("rank") <= k).select("key", F.col("o").alias("neighbour"), "rank", "cosine")


def pairs(neighbours: DataFrame, key: str = "vec_id") -> DataFrame:
    """``(vec_a, vec_b)``: the pairs in which at least one takes the other, smaller key first."""
    return neighbours.select(F.least(key, "neighbour").alias("vec_a"), F.greatest(key, "neighbour").alias("vec_b")).distinct()
