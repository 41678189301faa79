"""The trained tagger: decoding against all tag sequences, whole texts, learning."""

from collections import Counter
from itertools import product

import numpy as np
import pytest

from chartweave.operators import perceptron as P
from chartweave.operators.entities import score_chunks

WORDS = ["fever", "of", "Lyme", "acute", "pain", "12", "é"]


def random_model(seed, labels=("x", "y")):
    rng = np.random.default_rng(seed)
    model = P.Tagger.blank(labels)
    return P.Tagger(model.labels, rng.integers(-3, 4, model.weights.shape).astype(float), rng.integers(-3, 4, model.steps.shape).astype(float))


def brute_paths(model, words):
    """Every allowed tag sequence with its score, features summed place by place."""
    moves, slots = model.steps + model.allowed(), P.place_slots(words)
    for path in product(range(moves.shape[0]), repeat=len(words)):
        before = (0, *path[:-1])
        yield path, sum(model.weights[s, k].sum() + moves[b, k] for s, k, b in zip(slots, path, before, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_decoding_equals_all_sequences(seed):
    model, rng = random_model(seed), np.random.default_rng(seed)
    sentences = [list(rng.choice(WORDS, n)) for n in (1, 4, 2, 3, 4, 1)]
    emissions = model.emissions(sentences)
    for words, emission, path in zip(sentences, emissions, model.decode(emissions), strict=True):
        scores = dict(brute_paths(model, words))
        assert scores[tuple(path)] == max(scores.values()) > -np.inf
        share, total = model.certainty(emission), np.logaddexp.reduce(list(scores.values()))
        for place, tag in enumerate(path):
            want = np.exp(np.logaddexp.reduce([v for p, v in scores.items() if p[place] == tag]) - total)
            assert share[place, tag] == pytest.approx(want)
    assert model.decode([]) == [] and model.tag([None, "", " .\n", "?"]) == [[], [], [], []]


def test_gold_and_sequences():
    text = "Acute fever. Pain"
    assert [[text[a:b] for a, b in s] for s in P.sequences(text)] == [["Acute", "fever"], ["Pain"]]
    spans = P.join_overlaps([(3, 9, "x"), (0, 5, "x"), (9, 12, "x")])
    assert spans == [(0, 9, "x"), (9, 12, "x")]
    places = [(0, 2), (3, 5), (6, 9), (9, 10), (11, 12), (13, 14)]
    assert P.gold_path(places, spans, ["x"]).tolist() == [1, 2, 2, 1, 2, 0]


def test_learns_a_dictionary_and_marks_whole_texts(spark):
    rng = np.random.default_rng(3)
    filler = ["the", "patient", "shows", "with", "and", "mild", "no", "pain"]

    def text(n):
        words = list(rng.choice(filler, n))
        for at in rng.integers(0, n, n // 6):
            words[at] = rng.choice(["lyme disease", "acute fever"])
        return " ".join(words) + "."

    lexicon = spark.createDataFrame([("lyme disease",), ("acute fever",)], "term string")
    train = spark.createDataFrame([(n, text(30)) for n in range(60)] + [(60, None), (61, ""), (62, text(3000))], "note_id long, text string")
    sample = P.dictionary_sample(train, lexicon, "term", rows=50, chars=400)
    assert len(sample) == 50 and all(len(t) <= 400 for t, _ in sample) and sorted(sample) == sorted(P.dictionary_sample(train, lexicon, "term", rows=50, chars=400))
    model = P.fit(sample, ["term"])
    fresh = [(n, text(40)) for n in range(20)] + [(20, None), (21, ""), (22, text(20_000)), (0, "lyme disease"), (0, "lyme disease")]
    table = spark.createDataFrame([(n, t, "x") for n, t in fresh], "note_id long, text string, label string")
    got = sorted((r.note_id, r.start, r.end) for r in P.tag_texts(table, model).collect())
    want = sorted((n, a, a + len(w)) for n, t in fresh for w in ("lyme disease", "acute fever") for a in range(len(t or "")) if t.startswith(w, a))
    # Held-out agreement, since a model is not the dictionary; long and short texts alike.
    for part in (lambda n: n == 22, lambda n: n != 22):
        g, w = Counter(s for s in got if part(s[0])), Counter(s for s in want if part(s[0]))
        assert 2 * (g & w).total() / (g.total() + w.total()) > 0.97
    assert sum(n == 0 for n, *_ in got) == sum(n == 0 for n, *_ in want)
    chunks = spark.createDataFrame([("n", 0, "mild acute fever and pain.")], "note_id string, chunk_id int, chunk string")
    (span,) = score_chunks(chunks, {"perceptron": P.scorer(model)}).collect()
    assert (span.text, span.label, span.source) == ("acute fever", "term", "perceptron") and 0.5 < span.score <= 1
    assert P.tag_texts(table.limit(0), model).count() == 0
    assert P.fit([], ["term"]).tag(["lyme disease"]) == [[]]


def test_sequences_decoded_together_equal_each_alone(monkeypatch):
    rng = np.random.default_rng(5)
    model = P.Tagger(("a", "b"), rng.normal(0, 1, (P.SLOTS, 5)), rng.normal(0, 1, (5, 5)))
    emissions = [rng.normal(0, 1, (n, 5)) for n in (1, 7, 3, 3, 40, 1, 12)]
    for places in (P.PLACES, 50):  # all at once, and a few at a time
        monkeypatch.setattr(P, "PLACES", places)
        for e, path, share in zip(emissions, model.decode(emissions), model.certainties(emissions), strict=True):
            assert path.tolist() == model.decode([e])[0].tolist() and np.array_equal(share, model.certainty(e))


def test_spans_of_many_texts_equal_each_place_alone_and_take_little_time():
    import time

    rng = np.random.default_rng(7)
    model = P.Tagger(("a", "b"), rng.normal(0, 1, (P.SLOTS, 5)), rng.normal(0, 1, (5, 5)))
    words = ["Fever", "of", "é", "x" * 70, "Ünder_7", "y" * 200, "12", *(f"w{n}" for n in range(3000))]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) + ". " + "Of, é! x\n" * int(rng.integers(0, 3)) for _ in range(40)] + [None, "", "..", " -- "]
    for text, found in zip(texts, model.tag(texts), strict=True):
        want = []
        for places in P.sequences(text):
            emission = np.array([model.weights[s].sum(0) for s in P.place_slots([text[a:b] for a, b in places])])
            path, share = model.decode([emission])[0], model.certainty(emission)
            for first in np.flatnonzero(path % 2 == 1):
                last = first
                while last + 1 < len(path) and path[last + 1] == path[first] + 1:
                    last += 1
                want.append((places[first][0], places[last][1], model.labels[path[first] // 2], share[np.arange(first, last + 1), path[first : last + 1]].min()))
        assert [f[:3] for f in found] == [w[:3] for w in want] and [f[3] for f in found] == pytest.approx([w[3] for w in want])
    much = [" ".join(rng.choice(words[7:], 400)) + "." for _ in range(500)]
    started = time.process_time()
    model.tag(much)
    # Each place by itself took some four times this bound.
    assert time.process_time() - started < 1.5
