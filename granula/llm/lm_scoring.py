"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Corpus statistics come from all training documents: counts of all words, and counts of
neighbouring word classes. A class is one of the most frequent words, the end of a text, or
one of SUFFIXES hashed endings of all other words. One word in SHARE of all distinct ones,
FREQUENT at least, is a class of its own (of the SHIPPED most frequent at most).

The model predicts a vector from the CONTEXT classes before a word, each vector weighed by
its place: ``h = sum c[i] * q[class i before]``. The probability of a class is factored into
that of its group and that of the class within the group, both log-bilinear:
``h . R[group] + B[group]`` and ``h . r[class] + b[class]``, each normalised by a log-softmax.
Groups halve the classes along the main direction of their vectors. More than SIDE_BY_SIDE
groups are factored again, into the top that holds neighbouring groups and the group within
it, so a word costs three short matrix products.

The vectors start from a flat model of few classes (FREQUENT words) fitted on the driver to
the counts of pairs. Then each task goes over all words of its rows with steps on all factors,
noise-contrastive ones within groups and whole softmaxes above; its changes are weighed by the squares of their gradients, as
precisions, and added up. How rows are dealt to tasks changes the vectors a little. Within a
class, words have additive 0.5-smoothed frequencies, so the score of a text is a normalised
log10 probability in which all words never seen share one place of their class.

Counts of words that no bounded table holds are joined: only the SHIPPED most frequent words
(at most, counted over all rows) travel with the tasks; the others, which are rare in all
rows, meet their counts in a shuffled join.

Defined results: null and empty texts are one end token; a null doc_id counts as the empty
string for its fold; repeated rows each count and are each scored; without training tokens
counts are 0 and all words share one unseen place; very long texts are worked through in
parts of CHUNK words; input columns named like a result column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.llm.base import keep_memory, one_thread, received, send, slices, stored, table

FREQUENT, SUFFIXES, SHIPPED = 512, 128, 200_000
#: Distinct words for each word with a class of its own.
SHARE = 50
DIM, NOISE, BATCH, STEPS, RATE, SEED = 32, 64, 1024, 2000, 1.0, 7
#: Words before a word that predict it; noise samples of the class and the words of a group that share these; words of a step, and of a text that stay together in it.
CONTEXT, CLASS_NOISE, SHARING, STEP_WORDS, RUN = 3, 8, 16, 4096, 32
#: Groups beyond these are reached by a level of their own.
SIDE_BY_SIDE = 64
#: The end of a text among the words; no word is empty.
END = b""
FLUSH = 1_000_000
#: Rows whose words are held as Python objects at once.
SLICE = 500
BUCKETS = 16
#: Scores of a block of a softmax.
CACHED = 1 << 16
#: Of the pass over all words: words handled at once, rows of a block of vectors, step and its precision before any word.
CHUNK, BLOCK, STEP, PRIOR = 50_000, 1024, 0.14, 3.0


def fold(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; only ASCII letters and white space are looked at."""
    return (data or b"").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words() of all texts (binary), end to end, and the number of each."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))  # white space at either end would leave an empty piece
    blank = pc.equal(pc.binary_length(texts), 0)
    if pc.any(blank).as_py():
        texts = pc.if_else(blank, pa.scalar(None, pa.string()), texts)
    found = pc.ascii_split_whitespace(texts)
    return found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy().astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, seen) of ``docs`` (text, held_out): how often a word occurs in rows that train and in all, END included; counted in each partition before the shuffle."""

    kind = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("seen", pa.int64())])

    def summed(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum"), ("seen", "sum")])
        return found.select(["word", "c_sum", "seen_sum"]).rename_columns(kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0
        for batch in slices(batches, SLICE):
            found, lengths = split(batch.column(0))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            one = pa.table({"word": found.view(pa.binary()), "c": np.repeat(~out, lengths).astype(np.int64), "seen": np.ones(len(found), np.int64)})
            ends = pa.table({"word": pa.array([END], pa.binary()), "c": [int((~out).sum())], "seen": [len(out)]})
            parts.append(summed([one, ends]))
            held += len(parts[-1])
            if held > FLUSH:
                parts = [summed(parts)]
                if (held := len(parts[0])) > FLUSH // 2:
                    yield from parts[0].cast(kind).combine_chunks().to_batches()
                    parts, held = [], 0
        if parts:
            yield from summed(parts).cast(kind).combine_chunks().to_batches()

    rows = docs.select(F.col("text").cast("binary").alias("text"), "held_out")
    return rows.mapInArrow(run, "word binary, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


class Vocabulary:
    """The shipped words by falling count, their classes, and the size of each class."""

    def __init__(self, shipped: list[tuple[bytes, int]], by_suffix: dict[int, tuple[int, int]], n: int, v: int, frequent: int = FREQUENT):
        shipped = sorted(shipped, key=lambda x: (-x[1], x[0]))
        own = [w for w, c in shipped if w != END and c][:frequent]
        self.frequent, self.by_suffix = frequent, by_suffix
        self.words, self.counts, self.n, self.v = [w for w, _ in shipped], np.array([c for _, c in shipped], np.int64), n, v
        self.end, self.classes = frequent, frequent + 1 + SUFFIXES
        self.end_at = self.words.index(END) if END in self.words else -1
        place = {w: k for k, w in enumerate(own)} | {END: self.end}
        self.class_of = np.array([place[w] if w in place else self.suffix(w) for w in self.words], np.int64)
        # of the suffix classes: tokens and words without those that have a class of their own
        tokens, kinds = np.zeros(self.classes), np.zeros(self.classes)
        for k, (c, m) in by_suffix.items():
            tokens[frequent + 1 + k], kinds[frequent + 1 + k] = c, m
        for w, c in shipped:
            if w in place and c:
                tokens[place[w]] = c
                at = self.suffix(w)
                tokens[at] -= c
                kinds[at] -= 1
        self.room = np.log10(tokens + 0.5 * (kinds + 1))
        self.single = np.arange(self.classes) <= frequent
        self.tokens = tokens

    def finer(self) -> Vocabulary:
        """The same words with a class of their own for one in SHARE of all distinct words."""
        frequent = max(FREQUENT, min(len(self.words), self.v // SHARE))
        return Vocabulary(list(zip(self.words, self.counts.tolist(), strict=True)), self.by_suffix, self.n, self.v, frequent)

    def suffix(self, word: bytes) -> int:
        return self.frequent + 1 + zlib.crc32(word[-3:]) % SUFFIXES

    def array(self) -> pa.Array:
        return pa.array(self.words, pa.binary()).view(pa.string())

    def index(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words)), strict=True))


def vocabulary(counts: DataFrame, shipped: int = SHIPPED) -> tuple[Vocabulary, int]:
    """The vocabulary of the words that train, and the least number of occurrences of a shipped word.

    A histogram over logarithmic classes of occurrences (under 2000 rows) gives a number that
    at most ``shipped`` words reach, so what comes to the driver has a fixed bound. Held-out
    occurrences count for what is shipped, so no word that is left for the join is frequent.
    """
    bucket = F.floor(F.log2(F.col("seen").cast("double")) * BUCKETS).cast("int")
    suffix = (F.crc32(F.expr("substring(word, -3, 3)")) % SUFFIXES).cast("int")
    kinds, tokens = F.sum((F.col("c") > 0).cast("long")).alias("m"), F.sum("c").alias("c")
    sizes = sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), kinds, tokens).collect(), reverse=True)
    lowest, held = None, 0
    for b, n, _, _ in sizes:
        if (held := held + n) > shipped:
            break
        lowest = b
    top = [] if lowest is None else [(bytes(r.word), r.c, r.seen) for r in counts.where(bucket >= lowest).collect()]
    by_suffix = {r.k: (r.c, r.m) for r in counts.where("c > 0").groupBy(suffix.alias("k")).agg(kinds, tokens).collect()}
    least = min((n for _, _, n in top), default=1 << 62)
    return Vocabulary([(w, c) for w, c, _ in top], by_suffix, sum(s[3] for s in sizes), sum(s[2] for s in sizes)), least


def class_row(found: list[bytes], vocab: Vocabulary, index: dict[bytes, int], suffixes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of the words and the end: index among the shipped words (-1: none) and class; and the words that are not shipped."""
    at = np.fromiter(map(index.get, [*found, END], repeat(-1)), np.int64, len(found) + 1)
    kind = vocab.class_of[at] if len(vocab.words) else np.zeros(len(at), np.int64)
    missing = np.flatnonzero(at < 0)
    rest = [found[k] if k < len(found) else END for k in missing.tolist()]
    if rest:
        for w in rest:
            if w[-3:] not in suffixes:
                suffixes[w[-3:]] = vocab.suffix(w)
        kind[missing] = [vocab.end if w == END else suffixes[w[-3:]] for w in rest]
    return at, kind, rest


def class_pairs(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Counts [class before (the last row is the start), class] over all rows; at most classes ** 2 rows come to the driver."""
    n = vocab.classes
    sent = send(docs.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = received(sent)
        shipped, total = vocab.array(), np.zeros((n + 1) * n, np.int64)
        for batch in slices(batches, SLICE):
            _, kind, lengths, _ = class_rows(batch.column(0), vocab, shipped)
            total += np.bincount(contexts(kind, lengths, n, 1)[:, 0] * n + kind, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "c"])

    pairs = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    rows = pairs.toArrow()
    out = np.zeros((n + 1) * n, np.int64)
    out[rows["code"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(n + 1, n)


class Flat:
    """Class given the class before it: scores q[before] . r[class] + b[class]."""

    def __init__(self, q: np.ndarray, r: np.ndarray, b: np.ndarray):
        self.q, self.r, self.b = q, r, b

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probabilities of all classes after all contexts: one matrix product."""
        s = self.q @ self.r.T + self.b
        s -= s.max(axis=1, keepdims=True)
        return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


def log_softmax(h: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row of ``h @ rows.T`` the logarithm of its softmax at one place; worked through in blocks of CACHED scores, which stay in a core's cache."""
    out = np.empty(len(h), np.result_type(h, rows))
    one, step = np.ones(len(rows), out.dtype), max(1, CACHED // max(1, len(rows)))
    for lo in range(0, len(h), step):
        scores = h[lo : lo + step] @ rows.T
        chosen = scores[np.arange(len(scores)), at[lo : lo + step]]
        top = scores.max() if scores.size else 0.0
        if not -60.0 < top < 60.0:  # else no exponential is out of range and the greatest need not be taken off each row
            greatest = scores.max(axis=1)
            out[lo : lo + step] = chosen - greatest - np.log(np.exp(scores - greatest[:, None]) @ one)
        else:
            out[lo : lo + step] = chosen - np.log(np.exp(scores, out=scores) @ one + 1e-37)
    return out


def grouped(vectors: np.ndarray, tokens: np.ndarray, groups: int) -> np.ndarray:
    """The group of each class: classes are halved along the main direction of their vectors, by half their words and half their number."""
    weight = 0.5 * (tokens + 0.5) / (tokens + 0.5).sum() + 0.5 / len(tokens)
    parts = [np.arange(len(tokens))]
    while len(parts) < groups:
        k = int(np.argmax([weight[p].sum() if len(p) > 1 else 0.0 for p in parts]))
        part = parts[k]
        if len(part) < 2:
            break
        w = weight[part]
        x = vectors[part] - np.average(vectors[part], axis=0, weights=w)
        main = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
        order = np.lexsort((part, np.round(x @ main * np.sign(main[np.argmax(np.abs(main))]), 6)))
        upto = np.cumsum(w[order])
        cut = min(max(1, int(np.searchsorted(upto, upto[-1] / 2))), len(part) - 1)
        parts[k : k + 1] = [np.sort(part[order[:cut]]), np.sort(part[order[cut:]])]
    out = np.empty(len(tokens), np.int64)
    for k, part in enumerate(parts):
        out[part] = k
    return out


def reaches(groups: int) -> np.ndarray:
    """Where the groups of each top begin and end: neighbours, which the halving kept together; all in one if they are few."""
    tops = 1 if groups <= SIDE_BY_SIDE else round(groups**0.5)
    return np.arange(tops + 1) * groups // tops


def by_number(numbers: np.ndarray, below: int) -> np.ndarray:
    """The order of small numbers, equal ones as they stand; short ones are sorted by radix."""
    return np.argsort(numbers.astype(np.int16) if below < 1 << 15 else numbers, kind="stable")


class LogBilinear:
    """Class given the CONTEXT classes before it, by top (if groups are many), group within the top and class within the group.

    ``rows`` holds all vectors: contexts (the last one stands before a text), classes,
    groups and tops with their bias in the last column, and the weights of the places.
    """

    def __init__(self, rows: np.ndarray, group_of: np.ndarray):
        self.group_of, self.classes, self.groups = group_of, len(group_of), int(group_of.max()) + 1 if len(group_of) else 0
        self.reach = reaches(self.groups)
        self.top_of = np.repeat(np.arange(len(self.reach) - 1), np.diff(self.reach))
        self.set_rows(rows)
        self.order = np.argsort(group_of, kind="stable")  # classes by group
        self.place = np.empty(self.classes, np.int64)
        self.place[self.order] = np.arange(self.classes)
        self.begin = np.searchsorted(group_of[self.order], np.arange(self.groups + 1))

    def set_rows(self, rows: np.ndarray) -> None:
        n = self.classes
        self.rows = rows
        at = 2 * n + 1 + self.groups
        upto = at + (len(self.reach) - 1 if len(self.reach) > 2 else 0)
        self.q, self.r, self.wide, self.tops, self.places = rows[: n + 1], rows[n + 1 : 2 * n + 1], rows[2 * n + 1 : at], rows[at:upto], rows[upto:]

    @classmethod
    def started(cls, flat: Flat, tokens: np.ndarray, context: int = CONTEXT) -> LogBilinear:
        """From a flat model: the word before counts in full, others a little; a group starts as the mean of its classes, and these as what they differ by; so do tops and groups."""
        n, root = len(tokens), len(tokens) ** 0.5
        group_of = grouped(flat.r.astype(float), tokens, max(1, round(root if root <= SIDE_BY_SIDE else 2 * root)))
        groups = int(group_of.max()) + 1
        reach = reaches(groups)
        tops = len(reach) - 1 if len(reach) > 2 else 0
        rows = np.zeros((2 * n + 1 + groups + tops + context, flat.q.shape[1] + 1), np.float32)
        share = (tokens + 0.5) / (tokens + 0.5).sum()
        mass = np.bincount(group_of, share, groups)
        mean = np.stack([np.bincount(group_of, share * flat.r[:, k], groups) for k in range(flat.r.shape[1])], 1) / mass[:, None]
        at = 2 * n + 1 + groups
        rows[: n + 1, :-1], rows[n + 1 : 2 * n + 1, :-1], rows[n + 1 : 2 * n + 1, -1] = flat.q, flat.r - mean[group_of], flat.b - np.log(mass)[group_of]
        rows[2 * n + 1 : at, :-1], rows[2 * n + 1 : at, -1] = mean, np.log(mass)
        if tops:
            whole, of = np.add.reduceat(mass, reach[:-1]), np.repeat(np.arange(tops), np.diff(reach))
            middle = np.add.reduceat(mean * mass[:, None], reach[:-1], axis=0) / whole[:, None]
            rows[2 * n + 1 : at, :-1] -= middle[of]
            rows[2 * n + 1 : at, -1] -= np.log(whole)[of]
            rows[at : at + tops, :-1], rows[at : at + tops, -1] = middle, np.log(whole)
            at += tops
        rows[at, :-1], rows[at + 1 :, :-1] = 1.0, 0.1
        return cls(rows, group_of)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The predicted vectors of contexts (the nearest class first), with a 1 that meets the bias."""
        h = self.q.take(before[:, 0], axis=0)
        h *= self.places[0]
        for k in range(1, before.shape[1]):
            more = self.q.take(before[:, k], axis=0)
            more *= self.places[k]
            h += more
        h[:, -1] = 1.0
        return h

    def log10(self, before: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of classes after their contexts: one matrix product over the tops, one for each top over its groups and one for each group over its classes."""
        out, rows = np.empty(len(kind)), self.r.take(self.order, axis=0)
        for lo in range(0, len(kind), CHUNK):
            part = slice(lo, lo + CHUNK)
            group = self.group_of[kind[part]]
            order = by_number(group, self.groups)
            group, h, place = group[order], self.predicted(before[part][order]), self.place[kind[part][order]]
            found = np.zeros(len(order))
            if len(self.tops):
                found += log_softmax(h, self.tops, self.top_of[group])
            ends = np.searchsorted(group, self.reach)
            for t in np.flatnonzero(np.diff(ends)).tolist():
                at, first = slice(ends[t], ends[t + 1]), self.reach[t]
                found[at] += log_softmax(h[at], self.wide[first : self.reach[t + 1]], group[at] - first)
            ends = np.searchsorted(group, np.arange(self.groups + 1))
            for g in np.flatnonzero(np.diff(ends)).tolist():
                if self.begin[g + 1] - self.begin[g] > 1:
                    at = slice(ends[g], ends[g + 1])
                    found[at] += log_softmax(h[at], rows[self.begin[g] : self.begin[g + 1]], place[at] - self.begin[g])
            out[lo + order] = found
        return out / np.log(10)


def contexts(kind: np.ndarray, lengths: list[int], start: int, context: int = CONTEXT) -> np.ndarray:
    """The classes before each word, the nearest first, of texts laid end to end; ``start`` stands before a text."""
    first = np.cumsum([0, *lengths[:-1]]) if len(lengths) else np.empty(0, np.int64)
    place = np.arange(len(kind)) - np.repeat(first, lengths)
    out = np.full((len(kind), context), start, np.int64)
    for k in range(context):
        has = np.flatnonzero(place > k)
        out[has, k] = kind[has - k - 1]
    return out


def fit(pairs: np.ndarray, steps: int = STEPS, dim: int = DIM, noise: int = NOISE, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Flat:
    """Noise-contrastive estimation on pair counts with AdaGrad; the noise is the smoothed class frequency."""
    rng = np.random.default_rng(seed)
    contexts, classes = pairs.shape
    frequency = pairs.sum(axis=0) + 0.5
    pn = frequency / frequency.sum()
    log_noise = np.log(noise * pn)
    q, r, b = rng.normal(0, 0.1, (contexts, dim)), rng.normal(0, 0.1, (classes, dim)), np.log(pn)
    gq, gr, gb = np.full_like(q, 1e-2), np.full_like(r, 1e-2), np.full_like(b, 1e-2)
    flat = np.flatnonzero(pairs)
    if not len(flat):
        return Flat(q * 0, r * 0, b)
    cumulative = np.cumsum(pairs.ravel()[flat] / pairs.sum())
    cumulative_noise = np.cumsum(pn)
    draw = lambda c, n: np.minimum(np.searchsorted(c, rng.random(n)), len(c) - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def update(value, state, at, grad):
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.diff(at[order], prepend=-1))
        rows, total = at[order][heads], np.add.reduceat(grad[order], heads, axis=0)
        state[rows] += total * total
        value[rows] -= rate * total / np.sqrt(state[rows])

    for _ in range(steps):
        before, after = np.divmod(flat[draw(cumulative, batch)], classes)
        other = draw(cumulative_noise, noise)
        x, y, z = q[before], r[after], r[other]
        true = sigmoid((x * y).sum(axis=1) + b[after] - log_noise[after]) - 1
        false = sigmoid(x @ z.T + b[other] - log_noise[other])
        true, false = true / batch, false / batch
        dx = true[:, None] * y + false @ z
        dr = np.concatenate([true[:, None] * x, false.T @ x])
        at = np.concatenate([after, other])
        update(r, gr, at, dr)
        update(b, gb, at, np.concatenate([true, false.sum(axis=0)]))
        update(q, gq, before, dx)
    return Flat(q, r, b)


def spread_out(model: Flat, few: Vocabulary, vocab: Vocabulary) -> Flat:
    """``model`` of the classes of ``few`` for those of ``vocab``: each class starts as the one its words had."""
    was = np.zeros(vocab.classes, np.int64)
    was[vocab.class_of] = few.class_of
    was[vocab.frequent :] = np.arange(few.frequent, few.classes)
    share = np.log((vocab.tokens + 0.5) / (few.tokens[was] + 0.5))
    return Flat(model.q[np.append(was, few.classes)].astype(np.float32), model.r[was].astype(np.float32), (model.b[was] + share).astype(np.float32))


class Learner:
    """Noise-contrastive steps over the words of one task; a step size for each row of vectors."""

    def __init__(self, model: LogBilinear, tokens: np.ndarray, seed: int = SEED):
        self.model = LogBilinear(model.rows.copy(), model.group_of)
        self.first, self.state, self.rng = model.rows, np.zeros(len(model.rows)), np.random.default_rng(seed)
        share = (tokens + 0.5) / (tokens + 0.5).sum()
        mass = np.bincount(model.group_of, share, model.groups)
        self.classes_upto = np.cumsum(share[self.model.order])
        self.class_noise = np.log(CLASS_NOISE * share / mass[model.group_of]).astype(np.float32)

    def update(self, places: list[np.ndarray], grads: list[np.ndarray]) -> None:
        """A step along the gradients (a column for each of ``places``), added up by row."""
        at = np.concatenate(places)
        met = np.zeros(len(self.state), bool)
        met[at] = True
        rows = np.flatnonzero(met)
        number = np.empty(len(met), np.int64)
        number[rows] = np.arange(len(rows))
        at, grad = number[at], grads[0] if len(grads) == 1 else np.concatenate(grads, axis=1)
        total = np.empty((len(grad), len(rows)), np.float32)
        for k, g in enumerate(grad):
            total[k] = np.bincount(at, g, len(rows))
        total = np.ascontiguousarray(total.T)
        self.state[rows] += np.einsum("rd,rd->r", total, total) / total.shape[1]
        self.model.rows[rows] -= (STEP / np.sqrt(PRIOR + self.state[rows]))[:, None].astype(np.float32) * total

    def learn(self, before: np.ndarray, kind: np.ndarray) -> None:
        """All words once, as contexts() gives them: runs of RUN words of a text (fewer at its end) in another order."""
        place = np.arange(len(kind))
        since = place - np.maximum.accumulate(np.where(before[:, 0] == self.model.classes, place, 0))
        heads = np.flatnonzero(since % RUN == 0)
        order = self.rng.permutation(len(heads))
        lengths = np.diff(heads, append=len(kind))[order]
        heads, upto = heads[order], np.cumsum(lengths)
        cuts = np.append(np.flatnonzero(np.diff((upto - lengths) // STEP_WORDS, prepend=-1)), len(heads))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.step(before, kind, heads[lo:hi], lengths[lo:hi])

    def step(self, before: np.ndarray, kind: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> None:
        """One step over the words of some runs, each from its head on.

        Words of a run share their contexts, so these are looked up once, laid end to end
        with those that stand before the run, and weighed by shifting them against each other.
        """
        m, more = self.model, before.shape[1] - 1
        n, wide = m.classes, 2 * m.classes + 1
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        begin, count, run = np.cumsum(lengths) - lengths, lengths.sum(), np.arange(len(heads))
        of = np.repeat(run, lengths)
        words = np.arange(count) + (heads - begin)[of]
        spot = np.arange(count) + more * (of + 1)
        x = np.empty(count + more * len(heads), np.int64)
        x[spot] = before[words, 0]
        for k in range(1, more + 1):
            x[begin + more * (run + 1) - k] = before[heads, k]
        y = kind[words]
        order = by_number(m.group_of[y], m.groups)
        y, spot = y[order], spot[order]
        group = m.group_of[y]
        q = m.q.take(x, axis=0)
        mixed = q * m.places[0]
        for k in range(1, more + 1):
            mixed[k:] += q[:-k] * m.places[k]
        h = mixed.take(spot, axis=0)
        h[:, -1] = 1.0
        dh, levels = np.zeros_like(h), np.zeros((h.shape[1], m.groups + len(m.tops)), np.float32)

        def softmax(at: slice, first: int, upto: int, chosen: np.ndarray) -> None:
            """Gradients of the softmax of words ``at`` over the groups and tops from ``first`` to ``upto``."""
            rows = m.rows[wide + first : wide + upto]
            p = h[at] @ rows.T
            if not -60.0 < p.max() < 60.0:
                p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p /= (p @ np.ones(len(rows), p.dtype) + 1e-37)[:, None]
            p[np.arange(len(p)), chosen] -= 1
            dh[at] += p @ rows
            levels[:, first:upto] = h[at].T @ p

        if len(m.tops):
            softmax(slice(None), m.groups, m.groups + len(m.tops), m.top_of[group])
        ends = np.searchsorted(group, m.reach)
        for t in np.flatnonzero(np.diff(ends)).tolist():
            at, first = slice(ends[t], ends[t + 1]), m.reach[t]
            softmax(at, first, m.reach[t + 1], group[at] - first)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        # the class, against others of its group; SHARING words of a group share them
        sizes = np.diff(heads, append=len(group))
        several = (m.begin[group[heads] + 1] - m.begin[group[heads]]) > 1
        if several.any():
            blocks = np.where(several, -(-sizes // SHARING), 0)
            of = np.repeat(np.arange(len(heads)), blocks)
            begin = heads[of] + SHARING * (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            at = begin[:, None] + np.arange(SHARING)
            real = at < (heads + sizes)[of, None]
            at = np.where(real, at, begin[:, None])  # places without a word repeat the first one and count nothing
            low, high = m.begin[group[begin]], m.begin[group[begin] + 1]
            floor = np.append(0.0, self.classes_upto)
            u = floor[low, None] + self.rng.random((len(of), CLASS_NOISE)) * (floor[high] - floor[low])[:, None]
            drawn = m.order[np.clip(np.searchsorted(self.classes_upto, u), low[:, None], high[:, None] - 1)]
            hs, wrong = h.take(at, axis=0), m.r[drawn]
            false = sigmoid(hs @ wrong.transpose(0, 2, 1) - self.class_noise[drawn][:, None, :]) * real[:, :, None]
            placed = np.flatnonzero(real)
            mine = slice(None) if several.all() else at.ravel()[placed]  # words stay in their order
            right = m.r.take(y[mine], axis=0)
            true = sigmoid(np.einsum("bd,bd->b", h[mine], right) - self.class_noise[y[mine]]) - 1
            dh[mine] += true[:, None] * right + (false @ wrong).reshape(-1, h.shape[1]).take(placed, axis=0)
            grad = np.empty((h.shape[1], len(true) + drawn.size), np.float32)
            np.multiply(h[mine].T, true, out=grad[:, : len(true)])
            grad[:, len(true) :] = (false.transpose(0, 2, 1) @ hs).reshape(-1, h.shape[1]).T
            self.update([n + 1 + y[mine], n + 1 + drawn.ravel()], [grad])
        dh[:, -1] = 0.0
        down = np.zeros_like(mixed)
        down[spot] = dh
        back = down * m.places[0]
        for k in range(1, more + 1):
            back[:-k] += down[k:] * m.places[k]
        weighed = np.stack([np.einsum("bd,bd->d", down[k:], q[: len(q) - k]) for k in range(more + 1)], 1)
        self.update([np.arange(wide, len(m.rows))], [np.hstack([levels, weighed])])
        self.update([x], [np.ascontiguousarray(back.T)])

    def changes(self) -> np.ndarray:
        """Of each row the change times its precision, and what its words add to the precision."""
        gained = self.state.astype(np.float32)[:, None]
        return np.hstack([(self.model.rows - self.first) * (PRIOR + gained), gained])


def added(first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Rows of vectors after the summed changes of all tasks."""
    return first + change[:, :-1] / (PRIOR + change[:, -1:])


def class_rows(texts: pa.Array, vocab: Vocabulary, shipped: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """class_row() of all texts (binary), end to end: places among the shipped words, classes, lengths, and the words that are not shipped; ``shipped`` is vocab.array()."""
    found, lengths = split(texts)
    lengths = lengths + 1
    at = np.empty(lengths.sum(), np.int64)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(at), bool)
    inner[ends] = False
    # shipped words are looked up among the distinct ones of the texts: a table of all shipped words would cost more than the words
    distinct = found.dictionary_encode()
    place = pc.fill_null(pc.index_in(shipped, value_set=distinct.dictionary), len(distinct.dictionary)).to_numpy()
    shipped_at = np.full(len(distinct.dictionary) + 1, -1)
    shipped_at[place] = np.arange(len(shipped))
    at[inner] = shipped_at[distinct.indices.to_numpy()] if len(found) else 0
    at[ends] = vocab.end_at
    kind = vocab.class_of[at] if len(vocab.words) else np.zeros(len(at), np.int64)
    kind[ends] = vocab.end
    missing = at < 0
    if len(ends) and at[ends[0]] < 0:  # the ends are not shipped either
        place = np.zeros(len(at), np.int64)
        place[inner] = np.arange(1, len(found) + 1)
        rest = pa.concat_arrays([pa.array([END.decode()]), found]).take(pa.array(place[missing]))
    else:
        rest = found.filter(pa.array(missing[inner]))
    if len(rest):
        tails = pc.binary_slice(rest.view(pa.binary()), -3).dictionary_encode()
        classes = np.array([vocab.suffix(w) for w in tails.dictionary.to_pylist()], np.int64)
        kind[missing] = classes[tails.indices.to_numpy()]
        kind[ends] = vocab.end
    return at, kind, lengths, rest.view(pa.binary())


def trained(docs: DataFrame, vocab: Vocabulary, model: LogBilinear) -> LogBilinear:
    """``model`` after one pass over all words of ``docs``; its rows of vectors come to the driver once."""
    rows = len(model.rows)
    sent = send(docs.sparkSession, (vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        keep_memory()
        vocab, model = received(sent)
        learner, shipped, before, kinds = Learner(model, vocab.tokens), vocab.array(), [], []
        for batch in slices(batches, SLICE):
            _, kind, lengths, _ = class_rows(batch.column(0), vocab, shipped)
            before.append(contexts(kind, lengths, vocab.classes).astype(np.int32))
            kinds.append(kind)
            if sum(map(len, kinds)) > CHUNK:
                learner.learn(np.concatenate(before), np.concatenate(kinds))
                before, kinds = [], []
        if kinds:
            learner.learn(np.concatenate(before), np.concatenate(kinds))
        if learner.state.any():
            found = learner.changes()
            for at in range(0, rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([found[at : at + BLOCK].tobytes()], pa.binary())], ["block", "found"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None  # blocks come in order
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = np.frombuffer(raw, np.float32).astype(np.float64)
                if k != block and block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "found"])
                block, total = k, found if k != block else total + found
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "found"])

    kind = "block int, found binary"
    # each task sends vectors of all classes, so tasks grow with the cores and not with the rows
    few = docs.select(F.col("text").cast("binary").alias("text")).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(run, kind).select("block", F.spark_partition_id().alias("task"), "found")
    found = found.repartition("block").sortWithinPartitions("block", "task").mapInArrow(add, kind)  # summed in one order
    out = model.rows.copy()
    for block, raw in found.collect():  # each row of vectors once
        part = slice(block * BLOCK, (block + 1) * BLOCK)
        out[part] = added(out[part], np.frombuffer(raw, np.float32).reshape(-1, out.shape[1] + 1))
    return LogBilinear(out, model.group_of)


def rare_words(row: np.ndarray, words: pa.Array, rows: int) -> pa.Array:
    """Of each of ``rows`` texts its words that are not shipped, each once with its number; ``row`` rises."""
    found = pa.table({"row": row, "word": words}).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("row").combine_chunks()
    upto = np.searchsorted(found["row"].to_numpy(), np.arange(rows + 1)).astype(np.int32)
    whole = lambda name, kind: found[name].combine_chunks().cast(kind) if len(found) else pa.array([], kind)
    return pa.ListArray.from_arrays(upto, pa.StructArray.from_arrays([whole("word", pa.binary()), whole("count_all", pa.int64())], ["word", "tf"]))


def partial_scores(docs: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """(doc_id, held_out, h, n_tokens, known, shipped_sum, model_sum, rare) of every row.

    ``rare``: the words that are not shipped with their number; the sums lack log10(c + 0.5) of those.
    """
    sent = send(docs.sparkSession, (vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        keep_memory()
        vocab, model = received(sent)
        shipped = vocab.array()
        log_c = np.log10(np.append(vocab.counts, 0) + 0.5)  # the last place, index -1, is set to 0 for words that are not shipped
        log_c[-1] = 0.0
        known = np.append(vocab.counts > 0, False).astype(np.int64)
        inside = np.append(np.where(vocab.single[vocab.class_of], 0.0, log_c[:-1]) if len(vocab.words) else np.empty(0), 0.0)
        room = np.where(vocab.single, 0.0, vocab.room)
        for batch in slices(batches, SLICE):
            at, kind, lengths, rest = class_rows(batch.column(2), vocab, shipped)
            score = model.log10(contexts(kind, lengths, vocab.classes), kind) + inside[at] - room[kind]
            heads = np.cumsum(lengths) - lengths  # each text has its end at least
            total = lambda x, heads=heads: np.add.reduceat(x, heads) if len(x) else x
            rare = rare_words(np.repeat(np.arange(len(lengths)), lengths)[at < 0], rest, len(lengths))
            digests = [xxhash.xxh3_64_intdigest(data or b"") - (1 << 63) for data in batch.column(2).to_pylist()]
            new = [pa.array(digests, pa.int64()), pa.array(lengths, pa.int64()), pa.array(total(known[at]), pa.int64()), pa.array(total(log_c[at]), pa.float64()), pa.array(total(score), pa.float64()), rare]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["doc_id", "held_out", "h", "n_tokens", "known", "shipped_sum", "model_sum", "rare"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, h long, n_tokens long, known long, shipped_sum double, model_sum double, rare array<struct<word: binary, tf: long>>")


def scored(docs: DataFrame, held_out: Column, name: str = "lm") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out)
    train = docs.where(~F.col("held_out"))
    counts = stored(word_counts(docs), f"{name}-counts")
    vocab, least = vocabulary(counts)
    few, vocab = vocab, vocab.finer()
    flat = spread_out(fit(class_pairs(train, few)), few, vocab)
    model = trained(train, vocab, LogBilinear.started(flat, vocab.tokens))
    rows = stored(partial_scores(docs, vocab, model), f"{name}-rows")
    rare = rows.select("doc_id", "h", F.explode("rare").alias("r")).select("doc_id", "h", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    # a word that is left for the join occurs fewer than ``least`` times in all rows
    met = rare.join(counts.where(F.col("seen") < least), "word", "left").select(
        "doc_id", "h", (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("x"), F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0)).alias("k"), F.lit(0).alias("copies")
    )
    copies = rows.select("doc_id", "h", F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("k"), F.lit(1).alias("copies"))
    sums = met.union(copies).groupBy("doc_id", "h").agg(F.sum("x").alias("x"), F.sum("k").alias("k"), F.sum("copies").alias("copies"))
    sums = sums.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), (F.col("x") / F.col("copies")).alias("x"), (F.col("k") / F.col("copies")).cast("long").alias("k"))
    room = float(np.log10(vocab.n + 0.5 * (vocab.v + 1)))
    return rows.join(sums, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("k")).alias("n_known"), F.lit(int(vocab.n)).cast("long").alias("train_tokens"),
        (F.col("shipped_sum") + F.col("x") - F.col("n_tokens") * F.lit(room)).alias("base_score"), (F.col("model_sum") + F.col("x")).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose crc32(doc_id) mod 5 is not 1."""
    return scored(table(spark, sf_dir, "documents"), fold(5) == 1, name="op10")
