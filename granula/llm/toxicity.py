"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A unit is a word, or a run of single letters read as one. The kernel counts the gapped
three-letter subsequences two units share; a subsequence of span s weighs DECAY ** s and
spans end at SPAN characters, so inserted characters only lower the weight. Other signs than
letters are gaps. Kernels are normalised by the units' own.

Training takes a bounded sample of labelled rows (MAX_TOXIC and MAX_CLEAN, in the order of a
hash of doc_id); of rows with the same label and set of units the first trains, all others
are used. Units longer than LONGEST letters are cut into overlapping windows, in training as
in scoring. The machine is fitted on all strong units and the FIT_UNITS most frequent clean
ones. A sentence is as toxic as its strongest unit: starting from log-odds,
sentences of toxic documents give their strongest unit as positive, those of clean ones all
units as negative, and a squared-hinge machine on Nystroem features (kernels with landmarks,
whitened) is fitted; the choice is made again with its margins. The machine then is one
weight per subsequence, so scoring needs no landmark loop. A logistic model over the
strongest margins and the number and share of positive units turns a whole text into a score.

Only texts are inputs. Defined results: null and empty texts score like a text without any
unit; null doc_ids hash as the empty string; repeated rows are each scored; without labels
of both kinds all scores are the smoothed share of toxic labels; input columns named like a
result column are replaced.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.base import one_thread, received, send, slices, table
from granula.llm.lm_scoring import fold

MAX_TOXIC, MAX_CLEAN = 3000, 5000
DECAY, SPAN, LONGEST, LANDMARKS, ROUNDS, CACHE = 0.6, 6, 24, 96, 2, 400_000
#: Least lower bound of a unit's log-odds to be taken as the toxic part of a sentence.
SURE = 1.0
#: Distinct clean units that the machine is fitted on, at most, and units handled at once.
FIT_UNITS, PART = 40_000, 4_000
THRESHOLD = 0.3
#: Rows whose texts are Python objects at once.
HELD = 1000
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_CLASS = bytes(c - 96 if 97 <= c <= 122 else 0 for c in range(256))


class _Fold(dict):
    """Code point to letter class as a character: accents are dropped, anything else is a gap."""

    def __missing__(self, point: int) -> str:
        first = unicodedata.normalize("NFKD", chr(point).lower())[0]
        self[point] = out = chr(ord(first) - 96) if "a" <= first <= "z" else "\0"
        return out


_FOLD = _Fold()


def letters(raw: bytes) -> bytes:
    """Letters of a unit as 1 to 26 and all else as 0, without gaps at the ends."""
    if raw.isascii():
        return raw.lower().translate(_CLASS).strip(b"\0")
    return raw.decode(errors="replace").translate(_FOLD).encode("latin-1").strip(b"\0")


def units(data: bytes | None) -> list[bytes]:
    """White-space separated words of a UTF-8 text, then each run of three or more single characters as one unit."""
    found = (data or b"").lower().split()
    one = np.flatnonzero(np.fromiter(map(len, found), np.int64, len(found)) == 1)
    if len(one) < 3:
        return found
    runs = np.split(one, np.flatnonzero(np.diff(one) > 1) + 1)
    return found + [b"".join([found[k] for k in r]) for r in runs if len(r) >= 3]


def _padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(LONGEST, b"\0") for p in parts]), np.uint8).reshape(-1, LONGEST).astype(np.int32)


def _windows(part: bytes) -> list[bytes]:
    """Long units in overlapping windows; each unit has one at least."""
    return [part[k : k + LONGEST] for k in range(0, max(1, len(part) - LONGEST // 2), LONGEST // 2)] if len(part) > LONGEST else [part]


def _codes(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Codes of the subsequences at each pair of offsets, 0 where one sign is no letter, with their weight."""
    for a, b in OFFSETS:
        x, y, z = rows[:, :-b], rows[:, a : LONGEST - b + a], rows[:, b:]
        yield np.where((x > 0) & (y > 0) & (z > 0), x * 1024 + y * 32 + z, 0), DECAY ** (b + 1)


def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the explicit kernel features, equal codes of a row summed."""
    key, value = [], []
    for codes, weight in _codes(rows):
        at, col = np.nonzero(codes)
        key.append(at.astype(np.int64) << 15 | codes[at, col])
        value.append(np.full(len(at), weight))
    keys, where = np.unique(np.concatenate(key), return_inverse=True)
    return keys >> 15, keys & 32767, np.bincount(where, np.concatenate(value), len(keys))


def normalised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features divided by each row's norm."""
    row, code, weight = features(rows)
    norm = np.sqrt(np.bincount(row, weight * weight, len(rows)))
    return row, code, weight / norm[row]


def _dense(parts: list[bytes]) -> np.ndarray:
    """Normalised features of a few units as rows over all subsequences."""
    out = np.zeros((len(parts), 32768), np.float32)
    row, code, weight = normalised(_padded(parts))
    out[row, code] = weight
    return out


class Machine:
    """Margins of units and scores of texts."""

    def __init__(self, weights: np.ndarray, bias: float, logistic: np.ndarray, rest: float | None = None):
        self.weights, self.bias, self.logistic, self.rest = weights, bias, logistic, rest
        self.new: dict[bytes, float] = {}
        self.old: dict[bytes, float] = {}

    def margins(self, parts: list[bytes]) -> np.ndarray:
        """The machine's value for letter strings; subsequences of no landmark add nothing."""
        cut = [_windows(p) for p in parts]
        owner = np.repeat(np.arange(len(parts)), [len(c) for c in cut])
        rows = _padded([w for c in cut for w in c])
        top, first, second = np.zeros(len(rows)), rows << 10, rows << 5
        for a, b in OFFSETS:  # codes with a gap in them weigh nothing
            codes = first[:, :-b] | second[:, a : LONGEST - b + a] | rows[:, b:]
            top += DECAY ** (b + 1) * self.weights[codes].sum(axis=1)
        hot = np.flatnonzero(top > 0)
        value = np.full(len(rows), self.bias)
        if len(hot):
            row, _, weight = features(rows[hot])
            value[hot] += top[hot] / np.sqrt(np.bincount(row, weight * weight, len(hot)))
        out = np.full(len(parts), -np.inf)
        np.maximum.at(out, owner, value)
        return out

    def meet(self, texts: list[list[bytes]]) -> None:
        """Have the margins of all units of some texts at hand; two generations keep what is in use."""
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = []
        for u in set().union(*texts).difference(new):
            if u in old:
                new[u] = old[u]
            else:
                missing.append(u)
        for at in range(0, len(missing), PART):
            part = missing[at : at + PART]
            new.update(zip(part, self.margins([letters(u) for u in part]).tolist(), strict=True))

    def describe(self, found: list[bytes]) -> list[float]:
        """Strongest and second margin, positive units (log) and their share in percent."""
        if not found:
            return [self.bias, self.bias, 0.0, 0.0]
        m = np.fromiter(map(self.new.__getitem__, found), np.float64, len(found))
        n = int((m > 0).sum())
        top = np.partition(np.append(m, self.bias), -2)[-2:]
        return [top[1], top[0], np.log1p(n), min(100.0 * n / len(m), 10.0)]

    def described(self, texts: list[bytes | None], group: int = 200) -> np.ndarray:
        out = []
        for at in range(0, len(texts), group):
            found = [units(t) for t in texts[at : at + group]]
            self.meet(found)
            out += map(self.describe, found)
        return np.array(out).reshape(-1, 4)

    def scores(self, texts: list[bytes | None]) -> list[float]:
        if self.rest is not None:
            return [self.rest] * len(texts)
        x = self.described(texts) @ self.logistic[1:] + self.logistic[0]
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Primal support vector machine with squared hinge by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    eye = np.eye(len(w)) * ridge
    eye[-1, -1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * c[on, None]
        after = np.linalg.solve(eye + a.T @ x[on], a.T @ y[on])
        if np.allclose(after, w, atol=1e-8):
            break
        w = after
    return w


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps for ridge logistic regression; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)) * ridge
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _digest(found: list[bytes]) -> bytes:
    """Of a sorted set of letter strings, which hold no byte 255."""
    return hashlib.blake2b(b"\xff".join(found), digest_size=16).digest()


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 11) -> Machine:
    y = np.asarray(toxic, bool)
    if y.all() or not y.any():
        return Machine(np.zeros(32768), -1.0, np.zeros(5), rest=(y.sum() + 0.5) / (len(y) + 1.0))
    known: dict[bytes, bytes] = {}  # one object for each distinct unit
    docs = [sorted({known.setdefault(w, w) for u in map(letters, units(t)) for w in _windows(u)} - {b""}) for t in texts]  # long units by windows, as they are scored
    # copies would pass their words off as frequent: of texts with the same set of units and label the first stays
    first = {(_digest(d), bool(label)): k for k, (d, label) in reversed(list(enumerate(zip(docs, y, strict=True))))}
    own = np.array(sorted(first.values()))
    texts, docs, y = [texts[k] for k in own], [docs[k] for k in own], y[own]
    seen = [Counter(), Counter()]
    for d, label in zip(docs, y, strict=True):
        seen[int(label)].update(d)
    kinds = sorted(k for k in seen[0] | seen[1] if len(k) >= 3)
    place = {k: i for i, k in enumerate(kinds)}
    clean, bad = (np.array([s[k] for k in kinds], float) for s in seen)
    n_clean, n_bad = (~y).sum(), y.sum()
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    strength = odds - 1.64 * np.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))  # a lower bound of the log-odds

    # landmarks: strong units that are not near-copies of stronger ones, and frequent clean ones
    order = np.argsort(-strength, kind="stable")
    order = order[strength[order] > 0]
    chosen: list[bytes] = []
    held = np.empty((0, 32768), np.float32)
    for at in range(0, len(order), LANDMARKS):  # all strong units, few at once, until there are enough
        if len(chosen) >= LANDMARKS * 3 // 4:
            break
        part = [kinds[k] for k in order[at : at + LANDMARKS]]
        for kind, row in zip(part, _dense(part), strict=True):
            if len(chosen) < LANDMARKS * 3 // 4 and (not chosen or (held @ row).max() < 0.85):
                chosen.append(kind)
                held = np.vstack([held, row])
    usual = np.argsort(-clean, kind="stable")[: LANDMARKS - len(chosen)]
    marks = np.vstack([held, _dense([kinds[k] for k in usual])]).astype(np.float64)
    value, vector = np.linalg.eigh(marks @ marks.T)
    use = value > 1e-6 * value.max()
    whiten = vector[:, use] / np.sqrt(value[use])
    project = marks.T @ whiten  # subsequence -> Nystroem feature

    # strong units and the most frequent clean ones are enough to fit on
    fit_on = np.zeros(len(kinds), bool)
    fit_on[np.argsort(-clean, kind="stable")[:FIT_UNITS]] = True
    fit_on |= strength > SURE
    fitted = np.flatnonzero(fit_on)
    place_of = np.full(len(kinds), -1)
    place_of[fitted] = np.arange(len(fitted))
    z = np.zeros((len(fitted), project.shape[1]), np.float32)
    for at in range(0, len(fitted), PART):
        row, code, weight = normalised(_padded([kinds[k] for k in fitted[at : at + PART]]))
        for lo in range(0, len(row), 20 * PART):
            part = slice(lo, lo + 20 * PART)
            heads = np.flatnonzero(np.diff(row[part], prepend=-1))
            z[at + row[part][heads]] += np.add.reduceat(project[code[part]] * weight[part, None], heads)
    inside = [np.array([place[u] for u in d if u in place], np.int64) for d in docs]
    negative = np.unique(np.concatenate([inside[k] for k in np.flatnonzero(~y)] or [np.empty(0, np.int64)]))
    negative = negative[fit_on[negative]]
    margin = np.full(len(kinds), -1.0)
    w = np.zeros(z.shape[1] + 1)
    for _ in range(ROUNDS):
        # of each toxic text: its strongest units, and those the machine of the round before finds
        best = [d[(strength[d] > SURE) & ((strength[d] >= 0.93 * strength[d].max()) | (margin[d] > 0))] for d in (inside[k] for k in np.flatnonzero(y)) if len(d)]
        positive, times = np.unique(np.concatenate(best), return_counts=True) if best else (np.empty(0, int), np.empty(0))
        if not len(positive):
            break
        rows = np.concatenate([positive, negative])
        times = np.sqrt(times)
        weight = np.concatenate([times * (500.0 / times.sum()), np.full(len(negative), 500.0 / max(1, len(negative)))])
        w = squared_hinge(z[place_of[rows]].astype(float), np.concatenate([np.ones(len(positive)), -np.ones(len(negative))]), weight)
        margin[fitted] = z @ w[:-1] + w[-1]
    machine = Machine(project @ w[:-1], float(w[-1]), np.zeros(5))
    machine.weights[0] = 0.0
    machine.logistic = logistic_fit(machine.described(texts), y.astype(float))
    machine.new, machine.old = {}, {}
    return machine


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, max_toxic: int, max_clean: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most max_toxic and max_clean rows, the first in the order of a hash of doc_id."""
    ids = labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    order = F.xxhash64("doc_id")
    picked = [ids.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    few = F.broadcast(picked[0].union(picked[1]))  # max_toxic + max_clean rows at most
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(few, "doc_id").toArrow()
    at = sorted(range(rows.num_rows), key=lambda k, i=rows["doc_id"].to_pylist(): i[k])
    rows = rows.take(pa.array(at, pa.int64()))
    return rows["text"].to_pylist(), np.array(rows["toxic"].to_pylist(), int)


def scored(docs: DataFrame, machine: Machine, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    sent = send(docs.sparkSession, machine)  # 32768 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        machine = received(sent)
        for batch in slices(batches, HELD):
            scores = machine.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a machine trained on labels with crc32(doc_id) mod 4 other than 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(4) == 2
    machine = train(*labelled_sample(docs, labels, ~held_out, MAX_TOXIC, MAX_CLEAN))
    return scored(docs.select("doc_id", "text"), machine, held_out)
