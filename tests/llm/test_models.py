"""The tagger's decoding and gradients, and the class model's scores, by plain enumeration."""

import math
from collections import Counter
from itertools import product

import numpy as np

from parlance.llm import brown_lm
from parlance.llm.lstm_crf import Tagger


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(0)
    for seed in range(6):
        tagger = Tagger(3, hidden=4, embedding=3, seed=seed)
        tagger.p["step"] = rng.normal(0, 2, (3, 3)).astype(np.float32)
        x = rng.integers(0, 98, (6, 5))
        e, step = tagger.emissions(x), tagger.p["step"]
        got = tagger.decode(x)
        for k in range(5):
            score = lambda y: sum(e[t, k, y[t]] for t in range(6)) + sum(step[a, b] for a, b in zip(y, y[1:]))
            assert abs(score(got[:, k]) - max(map(score, product(range(3), repeat=6)))) < 1e-4


def test_loss_and_gradients_equal_enumeration():
    rng = np.random.default_rng(1)
    tagger = Tagger(3, hidden=3, embedding=3, seed=2)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    tagger.p["step"] = rng.normal(0, 1, (3, 3))
    x, y = rng.integers(0, 98, (4, 2)), rng.integers(0, 3, (4, 2))

    def loss():
        e, step, total = tagger.emissions(x), tagger.p["step"], 0.0
        for k in range(2):
            score = lambda z: sum(e[t, k, z[t]] for t in range(4)) + sum(step[a, b] for a, b in zip(z, z[1:]))
            total += math.log(sum(math.exp(score(z)) for z in product(range(3), repeat=4))) - score(y[:, k])
        return total / 8

    found, gradients = tagger.gradients(x, y)
    assert abs(found - loss()) < 1e-5
    for name, g in gradients.items():
        flat, own = tagger.p[name].reshape(-1), g.reshape(-1)
        places = np.argsort(-np.abs(own))[:3].tolist() + rng.integers(0, len(flat), 3).tolist()
        for i in places:
            was, size = flat[i], 1e-3
            flat[i] = was + size
            up = loss()
            flat[i] = was - size
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * size) - own[i]) < 2e-3 + 0.02 * abs(own[i]), name


def plain_scores(texts, rounds):
    """Scores of (doc_id, text, train) where all words are in the head: the model's definition, a dictionary at a time."""
    words_of = lambda t: (t or "").encode().lower().split()
    train = [words_of(t) for _, t, is_train in texts if is_train]
    counts = Counter(w for ws in train for w in ws)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    units = {w: i for i, w in enumerate(order, 1)}  # fewer than UNITS
    size = 1 + brown_lm.UNITS + brown_lm.TYPES
    classes = brown_lm.n_classes(len(counts))
    pairs = Counter((a, b) for ws in train for a, b in zip([None, *ws], [*ws, None]))
    table = np.zeros((size, size))
    for (a, b), n in pairs.items():
        table[units.get(a, 0), units.get(b, 0)] += n
    of_unit = brown_lm.exchange(table, classes)
    of = {None: 0} | {w: int(of_unit[u]) for w, u in units.items()}
    kind = lambda w: int(of_unit[1 + brown_lm.UNITS + brown_lm.type_of(w)])

    def bigrams():
        out = np.zeros((classes, classes))
        for (a, b), n in pairs.items():
            out[of[a], of[b]] += n
        return out

    for _ in range(rounds):
        big, new = bigrams(), {None: 0}
        for w in order:
            fit = []
            for c in range(1, classes):
                total = 0.0
                for (a, b), n in pairs.items():
                    if b == w:
                        total += n * math.log((big[of[a], c] + 0.5) / (big[of[a]].sum() + 0.5 * classes))
                    if a == w:
                        total += n * math.log((big[c, of[b]] + 0.5) / (big[c].sum() + 0.5 * classes))
                fit.append(total - counts[w] * math.log(big[:, c].sum() + 1))
            new[w] = 1 + int(np.argmax(np.round(fit, 9)))
        of = new
    big = bigrams()
    members = Counter(of[w] for w in order)
    scores = {}
    for doc_id, text, _ in texts:
        total, before = 0.0, 0
        for w in [*words_of(text), None]:
            c = of[w] if w in of else kind(w)
            total += math.log10((big[before, c] + 0.5) / (big[before].sum() + 0.5 * classes))
            if w is not None:
                total += math.log10((counts[w] + 1) / (big[:, c].sum() + members[c] + 1))
            before = c
        scores[doc_id] = total
    return scores


def test_class_model_equals_its_definition(spark):
    rng = np.random.default_rng(4)
    kinds = [["the", "a", "one"], ["red", "old", "tall", "odd"], ["cat", "dog", "tree", "house", "car"], ["runs", "falls", "sleeps"]]
    texts = []
    for i in range(90):
        said = " ".join(rng.choice(k) for _ in range(rng.integers(1, 4)) for k in kinds)
        texts.append((i, said + (" never seen" if i % 7 == 2 else ""), i % 7 != 2))
    texts += [(900, None, True), (901, "", False), (902, "Unknown WORDS only", False)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, train boolean")
    for rounds in (0, 1, 2):
        got = {r.doc_id: r.score for r in brown_lm.scored(docs, rounds).collect()}
        want = plain_scores(texts, rounds)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want), rounds


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(6)
    table = rng.poisson(rng.gamma(0.3, 3.0, (40, 40))).astype(float)
    h = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())

    def likelihood(of):
        member = np.eye(6)[of]
        t = member.T @ table @ member
        return h(t) - h(t.sum(0)) - h(t.sum(1))

    values = [likelihood(brown_lm.exchange(table, 6, rounds)) for rounds in range(6)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:])) and values[-1] > values[0]
