"""Problem 7: encoding a whole corpus with a public byte-level BPE tokenizer.

Method: speculate and verify. A word is first cut greedily into the longest vocabulary entries. A greedy cut
equals the result of merging exactly when every two neighbouring tokens are compatible, that is when no merge
across their border would have come before the merges that built them. All neighbouring pairs of a batch are
tested at once with numpy; only words with a failing pair are merged exactly.

Defined results: an empty text and a null text have the empty list of ids; a text of white space only has the
ids of its white space. Strings that look like special tokens are ordinary text. Repeated rows and rows with a
null key are encoded like any other; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.runtime import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 400_000
_FAR = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merge table and encoder of one tokenizer file (the JSON form with its merges)."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        size = max(vocab.values()) + 1
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        #: When a token is built (its merge's place), and of what; single bytes are there from the start.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for place, m in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i, j, t = vocab[a], vocab[b], vocab[a + b]
            self.merges[i, j] = (place, t)
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = place, i, j
        self.size = size
        keys = np.fromiter((i * size + j for i, j in self.merges), np.int64, len(self.merges))
        places = np.fromiter((p for p, _ in self.merges.values()), np.int64, len(keys))
        order = np.argsort(keys)
        self.pair_keys, self.pair_places = keys[order], places[order]
        self.vocab = vocab
        self.heads = {t[:n] for t in vocab for n in range(1, len(t) + 1)}
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def place_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the merge of each pair, far away where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_places[at], _FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether merging its bytes from scratch gives just this pair.

        Walks back in time: the younger of the two edge pieces is undone first, so every two pieces that ever
        lay side by side at the border are met once. A merge across is taken if it comes before the merge that
        next uses the left piece, and not after the one that next uses the right piece (leftmost first).
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        a_used, b_used = np.full(len(a), _FAR), np.full(len(a), _FAR)
        while len(at):
            place = self.place_of(a, b)
            crossed = (place < a_used) & (place <= b_used) & (place < _FAR)
            ok[at[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~crossed & ((made_a >= 0) | (made_b >= 0))
            at, a, b, a_used, b_used, made_a, made_b = (x[go] for x in (at, a, b, a_used, b_used, made_a, made_b))
            undo_a = made_a > made_b
            a_used, b_used = np.where(undo_a, made_a, a_used), np.where(undo_a, b_used, made_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, heads, vocab = [], 0, len(word), self.heads, self.vocab
        while i < n:
            best, end = self.byte_id[word[i]], i + 1
            j = i + 2
            while j <= n and (part := word[i:j]) in heads:
                if (t := vocab.get(part)) is not None:
                    best, end = t, j
                j += 1
            out.append(best)
            i = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging with a heap over a linked list: n log n also for very long words."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i] = self.merges[x, y][1]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t, x in zip(ids, alive) if x]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't in the cache: greedy cut, one test of all pairs, exact merging of the rest."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cut = [self.greedy(w) for w in raw]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((t for c in cut for t in c), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(cut)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) > 1 else np.array([], np.int64)
        key, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(key // self.size, key % self.size)[back]
        for i in np.unique(owner[inside[~good]]):
            cut[i] = self.merge(raw[i])
        self.cache.update(zip(words, cut))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        words = [self.find(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws if w not in self.cache}
        if new:
            self.learn(list(new))
        cache, out = self.cache, []
        for ws in words:
            ids: list[int] = []
            for w in ws:
                ids += cache[w]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def bpe(raw: bytes) -> Bpe:
    return Bpe(raw)


#: Texts encoded at a time; bounds a worker's memory, not the result.
SLICE_CHARS = 4_000_000


def slices(texts: list[str | None]):
    """Consecutive runs of rows with about SLICE_CHARS characters together."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _vocabulary(df: DataFrame, tokenizer: str):
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of about 1.5 MB


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, ids array<int>)``, one row per input row; a map over the scan, without a shuffle."""
    raw = _vocabulary(df, tokenizer)

    def run(batches):
        b = bpe(raw.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids = b.encode_batch(texts[lo:hi])
                ends = np.cumsum([0, *map(len, ids)])
                values = np.fromiter((t for x in ids for t in x), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    part = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return spread(part, "key").mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def with_token_count(df: DataFrame, columns: list[str], text: str = "text", tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``columns`` and the number of tokens of ``text`` (0 for empty and null)."""
    raw = _vocabulary(df, tokenizer)

    def run(batches):
        b = bpe(raw.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [len(x) for lo, hi in slices(texts) for x in b.encode_batch(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*columns, name])

    part = df.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return spread(part, columns[0]).mapInArrow(run, f"{schema}, {name} bigint")
