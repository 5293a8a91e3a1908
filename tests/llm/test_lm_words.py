"""Words, classes and steps of the language model by columns against the plain form."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from granula.llm import lm_scoring


def test_words_by_arrow_are_those_of_one_text():
    rng = random.Random(1)
    bits = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1f", b"\x00", b"A", b"z", b"\xc3\x84", b"\xe2\x80\x83", b"\xc2\x85", b"\xc2\xa0", b"Q", b"abc"]
    texts = [b"".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)] + [None, b"", b"   ", b"x" * 100_000]
    counts = Counter(w for t in texts for w in [*lm_scoring.words(t), lm_scoring.END])
    suffixes = {k: (10**6, 10**5) for k in range(lm_scoring.SUFFIXES)}
    for shipped in (40, 0):  # with none, the end is left for the join, too
        vocab = lm_scoring.Vocabulary(counts.most_common(shipped), suffixes, sum(counts.values()), len(counts), frequent=20)
        at, kind, lengths, rest = lm_scoring.class_rows(pa.array(texts, pa.binary()), vocab, vocab.array())
        plain = [lm_scoring.class_row(lm_scoring.words(t), vocab, vocab.index(), {}) for t in texts]
        assert lengths.tolist() == [len(p[0]) for p in plain]
        assert (at == np.concatenate([p[0] for p in plain])).all() and (kind == np.concatenate([p[1] for p in plain])).all()
        assert rest.to_pylist() == [w for p in plain for w in p[2]]
        rare = lm_scoring.rare_words(np.repeat(np.arange(len(lengths)), lengths)[at < 0], rest, len(lengths))
        assert [{r["word"]: r["tf"] for r in x} for x in rare.to_pylist()] == [dict(Counter(p[2])) for p in plain]


def test_a_step_sends_each_rows_gradient_once():
    rng = np.random.default_rng(2)
    rows, group_of = rng.normal(size=(2 * 30 + 1 + 5 + 3, 9)).astype(np.float32), np.arange(30) % 5
    learner = lm_scoring.Learner(lm_scoring.LogBilinear(rows, group_of), np.arange(30.0))
    places, grads = [np.array([3, 7, 3]), np.array([7])], [rng.normal(size=(9, 3)), rng.normal(size=(9, 1))]
    learner.update(places, grads)
    total = {3: grads[0][:, 0] + grads[0][:, 2], 7: grads[0][:, 1] + grads[1][:, 0]}
    for row, g in total.items():
        gained = (g * g).mean()
        assert np.allclose(learner.state[row], gained) and np.allclose(learner.model.rows[row], rows[row] - lm_scoring.STEP / np.sqrt(lm_scoring.PRIOR + gained) * g, atol=1e-5)
    others = np.setdiff1d(np.arange(len(rows)), [3, 7])
    assert (learner.model.rows[others] == rows[others]).all() and not learner.state[others].any()


def test_softmax_in_blocks_that_stay_in_the_cache(monkeypatch):
    rng = np.random.default_rng(3)
    h, rows, at = rng.normal(0, 1, (500, 9)), rng.normal(0, 1, (37, 9)), rng.integers(0, 37, 500)
    h[:5] *= 80  # blocks out of the range of plain exponentials
    scores = h @ rows.T
    shifted = scores - scores.max(axis=1, keepdims=True)
    want = shifted[np.arange(500), at] - np.log(np.exp(shifted).sum(axis=1))
    widest, log = [], np.log
    monkeypatch.setattr(lm_scoring.np, "log", lambda x: (widest.append(x.size), log(x))[1])
    monkeypatch.setattr(lm_scoring, "CACHED", 370)
    found = lm_scoring.log_softmax(h, rows, at)
    assert np.allclose(found, want) and max(widest) == 10 and lm_scoring.log_softmax(h[:0], rows, at[:0]).shape == (0,)


def chained(n, dim, group_of, rng, dtype=np.float32):
    """A model with random vectors."""
    groups = int(group_of.max()) + 1
    tops = len(lm_scoring.reaches(groups)) - 1
    rows = rng.normal(0, 0.3, (2 * n + 1 + groups + (tops if tops > 1 else 0) + lm_scoring.CONTEXT, dim + 1)).astype(dtype)
    rows[: n + 1, -1] = 0
    return lm_scoring.LogBilinear(rows, group_of)


def test_many_classes_take_few_scores_a_word(monkeypatch):
    rng = np.random.default_rng(4)
    n, words = 6400, 3000
    tokens = 1e6 / np.arange(1, n + 1)
    flat = lm_scoring.Flat(rng.normal(0, 0.3, (n + 1, 8)).astype(np.float32), rng.normal(0, 0.3, (n, 8)).astype(np.float32), np.log(tokens / tokens.sum()).astype(np.float32))
    model = lm_scoring.LogBilinear.started(flat, tokens)
    assert abs((10 ** model.log10(np.repeat([[3, 5, n]], n, 0), np.arange(n))).sum() - 1) < 1e-4
    made, real = [], lm_scoring.log_softmax
    monkeypatch.setattr(lm_scoring, "log_softmax", lambda h, rows, at: (made.append(len(h) * len(rows)), real(h, rows, at))[1])
    model.log10(rng.integers(0, n, (words, 3)), rng.choice(n, words, p=tokens / tokens.sum()))
    assert sum(made) / words < n**0.5  # with two levels 80 groups and about as many classes


def test_gradients_of_levels_and_contexts_are_those_of_the_likelihood(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (20, 100):  # one class in each group, so all of the likelihood is in groups and tops
        model = chained(n, 4, np.arange(n), rng, np.float64)
        lengths = [70, 1, 33, 2]
        kind = rng.integers(0, n, sum(lengths))
        before = lm_scoring.contexts(kind, lengths, n)
        sent = np.zeros(model.rows.shape)
        rows = []

        def take(self, places, grads, sent=sent, rows=rows):
            np.add.at(sent, np.concatenate(places), np.concatenate(grads, axis=1).T)
            rows.extend(np.concatenate(places).tolist())

        monkeypatch.setattr(lm_scoring.Learner, "update", take)
        lm_scoring.Learner(model, np.ones(n)).learn(before, kind)
        assert sum(r <= n for r in rows) < 1.3 * len(kind)  # contexts are shared by the words of a run
        like = lambda model=model, before=before, kind=kind: -np.log(10) * model.log10(before, kind).sum()
        for r, d in {*zip(rng.integers(0, len(model.rows), 60).tolist(), rng.integers(0, 5, 60).tolist(), strict=True), *((len(model.rows) - 1 - k, 2) for k in range(3)), (n, 1)}:
            if (r <= n or r >= len(model.rows) - 3) and d == 4:
                continue  # no bias
            was, model.rows[r, d] = model.rows[r, d], model.rows[r, d] + 1e-5
            more = like()
            model.rows[r, d] = was - 1e-5
            less = like()
            model.rows[r, d] = was
            assert abs((more - less) / 2e-5 - sent[r, d]) < 1e-3


def test_shipped_words_are_no_table_of_each_slice(monkeypatch):
    words = [b"w%d" % k for k in range(5000)]
    vocab = lm_scoring.Vocabulary([(w, 2) for w in [*words, lm_scoring.END]], {k: (10**6, 10**5) for k in range(lm_scoring.SUFFIXES)}, 10_002, 5001)
    tables, real = [], lm_scoring.pc.index_in
    monkeypatch.setattr(lm_scoring.pc, "index_in", lambda x, value_set: (tables.append(len(value_set)), real(x, value_set=value_set))[1])
    at, _, lengths, _ = lm_scoring.class_rows(pa.array([b" w7 w9 w7 none\n", None]), vocab, vocab.array())
    assert [vocab.words[k] if k >= 0 else None for k in at.tolist()] == [b"w7", b"w9", b"w7", None, b"", b""] and lengths.tolist() == [5, 1]
    assert sum(tables) < 100
