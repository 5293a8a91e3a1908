"""Operators use all that they are given, not a part of it."""

import random
import zlib
from itertools import combinations

from pyspark.sql import functions as F

from granula.llm import lm_scoring, toxicity


def test_toxicity_trains_on_unlike_texts_with_one_common_word():
    """A word of least hash in every text is no proof of a copy."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("aeioulnrst", k=6)) for _ in range(400)})
    bad = ["wabkyz", "qufmox", "kvumpy", "zgorbh"]
    mark = min(names, key=lambda n: zlib.crc32(toxicity.letters(n.encode())))
    names.remove(mark)
    clean = [" ".join([mark, *rng.choices(names, k=8)]) for _ in range(300)]
    toxic = [" ".join([mark, *rng.choices(names, k=7), bad[k % 4]]) for k in range(100)]
    assert min(zlib.crc32(toxicity.letters(w.encode())) for t in clean + toxic for w in t.split()) == zlib.crc32(toxicity.letters(mark.encode()))
    machine = toxicity.train([t.encode() for t in toxic + clean], [1] * len(toxic) + [0] * len(clean))
    scores = machine.scores([" ".join([*rng.choices(names, k=7), b]).encode() for b in bad] + [" ".join(rng.choices(names, k=8)).encode() for _ in range(4)])
    assert min(scores[:4]) > 0.5 > max(scores[4:])


def test_toxicity_landmarks_reach_past_many_spellings_of_one_insult(monkeypatch):
    """Rare insults become landmarks however many strong spellings of another stand before them."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("aeioulnrst", k=6)) for _ in range(400)})
    insult = "wabkyzgohbvupmjd"
    spelled = ["".join(c + "-" * (k in at) for k, c in enumerate(insult)) for n in range(4) for at in combinations(range(15), n)]
    rare = ["qufmoxyf", "cvumqqxk"]
    assert len(spelled) > 5 * toxicity.LANDMARKS
    clean = [" ".join(rng.choices(names, k=8)) for _ in range(600)]
    toxic = [" ".join([*rng.choices(names, k=3), *rng.sample(spelled, 12)]) for _ in range(600)] + [" ".join([*rng.choices(names, k=7), rare[k % 2]]) for k in range(12)]
    met = []
    monkeypatch.setattr(toxicity, "_dense", lambda parts, real=toxicity._dense: (met.extend(parts), real(parts))[1])
    toxicity.train([t.encode() for t in toxic + clean], [1] * len(toxic) + [0] * len(clean))
    assert {toxicity.letters(r.encode()) for r in rare} <= set(met)


def test_language_model_knows_the_context_of_words_past_a_fixed_rank(spark):
    """350 pairs that always stand together, with one ending and one count; 40,000 other words."""
    n, times = 350, 80
    pair = lambda a, b: f"p{a:03d}xyz s{b:03d}xyz"
    rows = [(k, pair(k % n, k % n)) for k in range(n * times)] + [(10**6 + k, " ".join(f"r{40 * k + i}" for i in range(40))) for k in range(1000)]
    late = range(200, n)  # after 512 words of the same count
    asked = [(2 * 10**6 + k, pair(k, k)) for k in late] + [(3 * 10**6 + k, pair(k, k - 7)) for k in late]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.scored(docs, F.col("doc_id") >= 2 * 10**6).collect()}
    assert sum(got[2 * 10**6 + k] - got[3 * 10**6 + k] for k in late) / len(late) > 0.05


def test_language_model_vectors_grow_with_the_words():
    shipped = [(b"w%d" % k, 3) for k in range(50_000)]
    few = lm_scoring.Vocabulary(shipped, {k: (150_000, 50_000) for k in range(lm_scoring.SUFFIXES)}, 150_000, 50_000)
    assert few.classes == 641 and few.finer().frequent == 1000
