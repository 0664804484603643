"""Problem 4: language labels of records and of the segments of mixed texts.

Method: hierarchical discrimination. Linear support vector machines on hashed character n-grams first decide the
language family of a line (one machine per family against the rest); within a family, one machine per pair of
languages votes. All machines are trained on the driver from the fixed table of sample sentences (at most
``TRAINING_ROWS`` of them); their weights are one matrix of 2 MB that is broadcast. Lines are scored with numpy, a
batch of lines at a time, in one map over the records without a shuffle.

The language of a record is the one that most of its letters are in, each line of at least ``SHORT`` letters counting
with the language found for it. A line that differs from the record's language only by a narrow margin stays with the record's
language; one without a sentence's end (a title, a caption, a menu full of names) must differ more clearly.

Defined results: null and blank texts, and texts without letters, have no language (null, confidence 0). Lines
shorter than ``SHORT`` letters take the record's language. Ties between languages go to the first code. Repeated
rows are handled alike; extra columns are ignored. Only languages with samples can be assigned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.runtime import spread

TRAINING_ROWS = 20_000
FEATURES = 1 << 15
MIN_LETTERS, SHORT = 40, 20
#: How clearly, on the scale of sqrt(n-grams), a line must differ from its record's language.
DIFFERS, TITLE_DIFFERS = 1.0, 3.0
#: A sentence's end somewhere in the line.
_SENTENCE = re.compile(r"[.!?。！？…](?:\s|[\"”“»’)）」]|\Z|[^\W\d_a-z])").search
#: Language families by ISO 639-1 code; a code in none of them is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ca ro gl oc la",
    "slavic-latin": "pl cs sk sl hr bs",
    "cyrillic": "ru bg uk be sr mk",
    "east-asian": "ja zh",
}


def family_of(code: str) -> str:
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), code)


def _classes() -> np.ndarray:
    """For every 16-bit code: 0 not a letter, else the code (lower-case text is expected); line feeds are kept."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    table[0x27] = 0x27
    table[10] = 10
    return table


_TABLE: list[np.ndarray] = []
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def featurise(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, line) of every n-gram (n = 1 to 4, not across words but with their edges) of the lines; letters of each line."""
    if not _TABLE:
        _TABLE.append(_classes())
    text = "\n".join(x.replace("\n", " ") for x in lines).lower() + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _TABLE[0][np.where(c < 1 << 16, c, 0x4E00)]
    ends = c == 10
    line = np.cumsum(ends) - ends
    letter = (c > 0) & ~ends
    letters = np.bincount(line[letter & (c != 0x27)], minlength=len(lines))[: len(lines)]
    c = np.where(letter, c, np.uint32(0))
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(3, np.uint32)])
    line = np.concatenate([line[:1], line, np.full(3, len(lines) - 1)])
    n = len(c) - 3
    word = c > 0
    feats, owners = [], []
    h = np.zeros(n, np.uint32)
    inner = np.ones(n, bool)
    for k in range(4):
        h = (h ^ c[k : n + k]) * _MUL[k]
        h ^= h >> np.uint32(13)
        if k >= 2:
            inner &= word[k - 1 : n + k - 1]
        keep = inner & word[:n] if k == 0 else inner & (word[:n] | word[k : n + k]) & (line[:n] == line[k : n + k]) if k < 3 else inner & (line[:n] == line[k : n + k])
        at = np.flatnonzero(keep)
        feats.append(((h[at] * np.uint32(0x2545F491)) >> np.uint32(17)).astype(np.int64)), owners.append(line[at])
    return np.concatenate(feats), np.concatenate(owners), letters


def _svm(gram: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Dual coefficients (times labels) of a linear machine without an offset, by coordinate ascent."""
    a, f = np.zeros(len(y)), np.zeros(len(y))
    upper = np.where(y > 0, c * (y < 0).sum() / len(y), c * (y > 0).sum() / len(y)) * 2
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(a[i] + (1 - y[i] * f[i]) / gram[i, i], 0.0), upper[i])
            if new != a[i]:
                f += (new - a[i]) * y[i] * gram[i]
                a[i] = new
    return a * y


class Model:
    """Languages, families, and one weight column for each family and each pair of languages of a family."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in rows})
        self.families = sorted({family_of(x) for x in self.languages})
        self.members = [[i for i, x in enumerate(self.languages) if family_of(x) == f] for f in self.families]
        self.family = np.array([self.families.index(family_of(x)) for x in self.languages])
        self.pairs = [(i, j) for m in self.members for k, i in enumerate(m) for j in m[k + 1 :]]
        feats, owners, _ = featurise([t for _, t in rows])
        x = np.zeros((len(rows), FEATURES), np.float32)
        np.add.at(x, (owners, feats), 1)
        # rare n-grams tell less: damp counts, then unit length
        x = np.sqrt(x)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        gram = (x @ x.T).astype(np.float64) + 1e-9 * np.eye(len(rows))
        lang = np.array([self.languages.index(a) for a, _ in rows])
        columns = []
        for f in range(len(self.families)):
            y = np.where(self.family[lang] == f, 1.0, -1.0)
            columns.append(x.T @ _svm(gram, y).astype(np.float32) if abs(y.sum()) < len(y) else np.zeros(FEATURES, np.float32))
        for i, j in self.pairs:
            at = np.flatnonzero((lang == i) | (lang == j))
            y = np.where(lang[at] == i, 1.0, -1.0)
            columns.append(x[at].T @ _svm(gram[np.ix_(at, at)], y).astype(np.float32))
        self.weights = np.ascontiguousarray(np.stack(columns, axis=1), np.float32)

    def scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Decision values (line, machine), as sums over n-grams divided by the root of their number; and letters."""
        feats, owners, letters = featurise(lines)
        order = np.argsort(owners, kind="stable")
        feats, owners = feats[order], owners[order]
        n = np.bincount(owners, minlength=len(lines))
        out = np.zeros((len(lines), self.weights.shape[1]), np.float32)
        if len(feats):
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            who = owners[starts]
            for lo in range(0, len(starts), 512):
                a, b = starts[lo], starts[lo + 512] if lo + 512 < len(starts) else len(feats)
                out[who[lo : lo + 512]] = np.add.reduceat(self.weights[feats[a:b]], starts[lo : lo + 512] - a, axis=0)
        return out / np.sqrt(np.maximum(n, 1))[:, None], letters

    def margins(self, s: np.ndarray) -> np.ndarray:
        """How far each language stands above the best other one, by the hierarchy: (line, language)."""
        nf, nl = len(self.families), len(self.languages)
        duel = np.full((len(s), nl, nl), np.inf, np.float32)
        fam = s[:, :nf][:, self.family]
        duel = fam[:, :, None] - fam[:, None, :]
        for p, (i, j) in enumerate(self.pairs):
            duel[:, i, j], duel[:, j, i] = s[:, nf + p], -s[:, nf + p]
        duel[:, np.arange(nl), np.arange(nl)] = np.inf
        return duel

    def best(self, s: np.ndarray) -> np.ndarray:
        """Family first, then the votes of its pairs (the sum of their values decides between equal votes)."""
        nf = len(self.families)
        fam = s[:, :nf].argmax(axis=1)
        votes = np.zeros((len(s), len(self.languages)), np.float32)
        for p, (i, j) in enumerate(self.pairs):
            v = s[:, nf + p]
            votes[:, i] += (v > 0) + 1e-3 * np.tanh(v)
            votes[:, j] += (v <= 0) - 1e-3 * np.tanh(v)
        votes[self.family[None, :] != fam[:, None]] = -np.inf
        return votes.argmax(axis=1)

    def judge(self, lines: list[str], letters: np.ndarray, best: np.ndarray, duel: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        """(language of the record, confidence, languages of its lines, confidences of its lines)."""
        nl = len(self.languages)
        counted = letters >= SHORT
        if not counted.any():
            counted = letters > 0
        if not counted.any():
            return -1, 0.0, np.full(len(letters), -1), np.zeros(len(letters))
        rows = np.arange(len(best))
        weight = np.bincount(best[counted], letters[counted], minlength=nl)
        main = int(weight.argmax())
        need = np.full(len(best), TITLE_DIFFERS)
        for i in np.flatnonzero(counted & (best != main)):
            if _SENTENCE(lines[i]):
                need[i] = DIFFERS
        clear = counted & (duel[rows, best, main] >= need)
        lang = np.where(clear, best, main)
        weight = np.bincount(lang[counted], letters[counted], minlength=nl)
        if int(weight.argmax()) != main:
            main = int(weight.argmax())
            lang = np.where(counted & (duel[rows, best, main] >= need), best, main)
        least = duel[rows, lang].min(axis=1) if nl > 1 else np.full(len(lang), 9.0)
        sure = 1 / (1 + np.exp(-np.clip(2 * least, -30, 30)))
        return main, float((sure * letters * (lang == main) * counted).sum() / max((letters * counted).sum(), 1)), lang, sure


def train(samples: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """The model fitted on at most TRAINING_ROWS labelled sentences (all of them in a table of samples)."""
    rows = samples.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(F.trim(lang)), text).orderBy(F.xxhash64(text)).limit(TRAINING_ROWS).collect()
    if not rows:
        raise ValueError("no labelled samples to train on")
    return Model([(r[0], r[1]) for r in rows])


def identify(df: DataFrame, model: Model, rec: str = "rec_id", text: str = "text") -> DataFrame:
    """``(rec, line_no, lang, confidence, letters)``: with line_no -1 the record (letters of its whole text), and one
    row for each line of at least MIN_LETTERS letters."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        names = np.array([*m.languages, None], object)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start in range(0, len(texts), 256):
                part = texts[start : start + 256]
                split = [t.split("\n") if t else [] for t in part]
                lines = [x for ls in split for x in ls]
                if lines:
                    s, letters = m.scores(lines)
                    best, duel = m.best(s), m.margins(s)
                out: list[list] = [[], [], [], [], []]
                at = 0
                for i, ls in enumerate(split):
                    k = slice(at, at + len(ls))
                    at += len(ls)
                    main, sure, lang, each = m.judge(ls, letters[k], best[k], duel[k]) if ls else (-1, 0.0, None, None)
                    total = int(letters[k].sum()) if ls else 0
                    rows = [(start + i, -1, main, sure, total)]
                    if ls and main >= 0:
                        rows += [(start + i, int(j), int(lang[j]), float(each[j]), int(letters[k][j])) for j in np.flatnonzero(letters[k] >= MIN_LETTERS)]
                    for col, v in zip(out, zip(*rows)):
                        col.extend(v)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(names[np.array(out[2], int)].tolist(), pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int64())],
                    names=["rec", "line_no", "lang", "confidence", "letters"],
                )

    kind = df.schema[rec].dataType.simpleString()
    part = df.select(F.col(rec).alias("rec"), F.col(text).cast("string").alias("t"))
    return spread(part, "rec").mapInArrow(run, f"rec {kind}, line_no int, lang string, confidence double, letters bigint").withColumnRenamed("rec", rec)


def wrong_labels(df: DataFrame, model: Model, codes: list[str], rec: str = "rec_id", text: str = "text", label: str = "language") -> DataFrame:
    """``(rec, line_no, lang)``: line_no -1 for records of at least MIN_LETTERS letters whose label is missing, unknown
    or not the language found; and every counted line of records whose counted lines are in several languages.

    A record's lines are told apart in the row itself, so nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast((model, frozenset(c.lower() for c in codes)))

    def run(batches):
        m, known = shared.value
        for b in batches:
            texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list[tuple[int, int, str]] = []
            for start in range(0, len(texts), 256):
                split = [t.split("\n") if t else [] for t in texts[start : start + 256]]
                lines = [x for ls in split for x in ls]
                if not lines:
                    continue
                s, letters = m.scores(lines)
                best, duel = m.best(s), m.margins(s)
                at = 0
                for i, ls in enumerate(split, start):
                    k = slice(at, at + len(ls))
                    at += len(ls)
                    if not ls or letters[k].sum() < MIN_LETTERS:
                        continue
                    main, _, lang, _ = m.judge(ls, letters[k], best[k], duel[k])
                    own = (labels[i] or "").strip().lower().split("-")[0]
                    if own not in known or own != m.languages[main]:
                        out.append((i, -1, m.languages[main]))
                    long = np.flatnonzero(letters[k] >= MIN_LETTERS)
                    if len(set(lang[long])) > 1:
                        out += [(i, int(j), m.languages[lang[j]]) for j in long]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["rec", "line_no", "lang"])

    kind = df.schema[rec].dataType.simpleString()
    part = df.select(F.col(rec).alias("rec"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).filter("t is not null")
    return spread(part, "rec").mapInArrow(run, f"rec {kind}, line_no int, lang string").withColumnRenamed("rec", rec)
