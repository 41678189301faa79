"""A trained span tagger behind the scorer hook (E3, E7): averaged structured perceptron, Viterbi decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.operators.tagger import tag_terms

#: Words, the marks at which a sequence ends, and what lies between.
_TOKENS = re.compile(r"\w+|[.!?\n]")
_PIECES = re.compile(r"\w+|[.!?\n]|[^\w.!?\n]+")
#: Hashed features; the model is SLOTS x tags numbers, whatever it was trained on.
SLOTS = 1 << 16
#: Roles in which a word votes for the tag of a place: itself, the one before, the one after;
#: a pair of adjacent words votes for its first and its second place.
ROLES = ("0", "-", "+")
PAIR_ROLES = ("1", "2")
#: Pieces that a task remembers and their characters, places that are decoded and characters that are tagged at a time.
REMEMBERED, HELD, PLACES, CHARS = 1 << 18, 1 << 24, 1 << 18, 1 << 20
Spans = list[tuple[int, int, str]]


def sequences(text: str | None) -> list[list[tuple[int, int]]]:
    """Word offsets of a whole text, cut at sentence marks."""
    out: list[list[tuple[int, int]]] = [[]]
    for m in _TOKENS.finditer(text or ""):
        if m.group() in ".!?\n":
            if out[-1]:
                out.append([])
        else:
            out[-1].append(m.span())
    return [s for s in out if s]


@lru_cache(REMEMBERED)
def word_slots(word: str, role: str) -> list[int]:
    """Feature slots of a word in a role; the empty word is the edge of a sequence."""
    low = word.lower()
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", word)))
    parts = [f"w{low}"] + ([f"s{shape[:6]}", f"p{low[:3]}", f"e{low[-3:]}"] if role == "0" else [f"e{low[-3:]}"])
    return [zlib.crc32(f"{role}{p}".encode()) % SLOTS for p in parts]


class _Shapes(dict):
    """What a character is in a word's shape."""

    def __missing__(self, c: str) -> str:
        out = self[c] = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", c)))
        return out


_SHAPES = _Shapes()


def many_word_slots(words: list[str]) -> list[np.ndarray]:
    """:func:`word_slots` of many words, an array for each role."""
    lows = [w.lower() for w in words]
    parts = {
        "w": [w.encode() for w in lows], "s": ["".join(map(_SHAPES.__getitem__, w[:6])).encode() for w in words],
        "p": [w[:3].encode() for w in lows], "e": [w[-3:].encode() for w in lows],
    }

    def slots(role: str, kind: str) -> np.ndarray:
        before = zlib.crc32(f"{role}{kind}".encode())
        return np.array([zlib.crc32(p, before) for p in parts[kind]], np.int64) % SLOTS

    return [np.stack([slots(r, k) for k in ("wspe" if r == "0" else "we")], axis=1) for r in ROLES]


@lru_cache(REMEMBERED)
def pair_slots(first: str, second: str, role: str) -> list[int]:
    """Feature slot of two adjacent words in a role."""
    return [zlib.crc32(f"{role}{first.lower()} {second.lower()}".encode()) % SLOTS]


def place_slots(words: list[str]) -> list[np.ndarray]:
    """All feature slots of every place of a sequence."""
    w = ["", *words, ""]
    return [
        np.array([
            *word_slots(w[n], "0"), *word_slots(w[n - 1], "-"), *word_slots(w[n + 1], "+"), *pair_slots(w[n], w[n + 1], "1"), *pair_slots(w[n - 1], w[n], "2"),
        ])
        for n in range(1, len(w) - 1)
    ]


def _crc_shifts(most: int) -> np.ndarray:
    """What a CRC-32 becomes behind 0 to ``most`` more zero bytes, for every value of each of its bytes."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    now = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(most):
        now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
        out.append(now)
    return np.array(out)


#: Shifts by up to this many bytes are tabled.
SHIFT = 64
_SHIFTS = _crc_shifts(SHIFT)


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of strings, from that of each and the second one's bytes."""
    first, size = first.copy(), size.copy()

    def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce([_SHIFTS[by, b, (crc >> np.uint32(8 * b)) & np.uint32(255)] for b in range(4)])

    while len(long := np.flatnonzero(size > SHIFT)):
        first[long] = shifted(first[long], np.full(len(long), SHIFT))
        size[long] -= SHIFT
    return shifted(first, size) ^ second


class Words(dict):
    """Numbers of a task's pieces, with their kind (word, mark, other), their votes alone, and checksums of which pairs' slots are made.

    Number 0 is the edge of a sequence. All are forgotten beyond a bound.
    """

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._forget()

    def _forget(self) -> None:
        self.clear()
        tags = self.weights.shape[1]
        self.kind, self.votes = np.zeros(0, np.int8), np.zeros((len(ROLES), 0, tags))
        self.opens, self.crc, self.size = np.zeros((len(PAIR_ROLES), 0), np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.fresh, self.held = [], 0
        self[""]

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        number = self[piece] = len(self)
        return number

    def numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED or self.held > HELD:
            self._forget()
        out = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        new, self.fresh = self.fresh, []
        if not new:
            return out
        self.held += sum(map(len, new))
        kind = np.array([1 if p and p in ".!?\n" else 2 if p and not re.match(r"\w", p) else 0 for p in new], np.int8)
        words = [p if k == 0 else "" for p, k in zip(new, kind.tolist(), strict=True)]
        low = [w.lower().encode() for w in words]
        self.kind = np.concatenate([self.kind, kind])
        votes = [self.weights[slots].sum(1) for slots in many_word_slots(words)]
        self.votes = np.concatenate([self.votes, votes], axis=1)
        opens = np.array([[zlib.crc32(r.encode() + w + b" ") for w in low] for r in PAIR_ROLES], np.uint32)
        self.opens = np.concatenate([self.opens, opens], axis=1)
        self.crc = np.concatenate([self.crc, np.array([zlib.crc32(w) for w in low], np.uint32)])
        self.size = np.concatenate([self.size, np.array([len(w) for w in low], np.int64)])
        return out

    def emissions(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of every tag at every place of sequences that lie one after the other; ``first`` tells where one begins."""
        before, after = np.zeros_like(words), np.zeros_like(words)
        before[1:] = np.where(first[1:], 0, words[:-1])
        after[:-1] = np.where(first[1:], 0, words[1:])

        def pairs(role: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return self.weights[joined_crc(self.opens[role, a], self.crc[b], self.size[b]) % SLOTS]

        alone = self.votes[0][words] + self.votes[1][before] + self.votes[2][after]
        return alone + pairs(0, words, after) + pairs(1, before, words)


def _by_length(emissions: np.ndarray, lengths: np.ndarray, run: Callable) -> list[tuple[np.ndarray, np.ndarray]]:
    """``run`` over sequences that lie one after the other, those of a like length together, the longest first, a bounded number of
    places at a time: places and what ``run`` tells of them."""
    order = np.argsort(-lengths, kind="stable")
    starts, out = np.cumsum(lengths) - lengths, []
    while len(order):
        many = max(1, PLACES // max(1, int(lengths[order[0]])))
        some, order = order[:many], order[many:]
        own = lengths[some]
        column = np.repeat(np.arange(len(some)), own)
        step = np.arange(len(column)) - np.repeat(np.cumsum(own) - own, own)
        at = starts[some][column] + step
        places = np.zeros((own[0], len(some), emissions.shape[1]))
        places[step, column] = emissions[at]
        live = np.searchsorted(-own, -np.arange(own[0]), side="left").tolist()
        out.append((at, run(places, live)[step, column]))
    return out


def _cut(values: np.ndarray, emissions: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(e) for e in emissions])[:-1])


@dataclass
class Tagger:
    """Tags are O, then B and I of every label; ``steps[i, j]`` scores tag j after tag i, row 0 also opens a sequence."""

    labels: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray

    @classmethod
    def blank(cls, labels: Sequence[str]) -> Tagger:
        tags = 1 + 2 * len(labels)
        return cls(tuple(labels), np.zeros((SLOTS, tags)), np.zeros((tags, tags)))

    def allowed(self) -> np.ndarray:
        """0 where tag j may follow tag i, else minus infinity: an I only follows the B or I of its label."""
        tags = self.steps.shape[0]
        out = np.zeros((tags, tags))
        for n in range(len(self.labels)):
            out[:, 2 + 2 * n] = -np.inf
            out[[1 + 2 * n, 2 + 2 * n], 2 + 2 * n] = 0
        return out

    def emissions(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Score of every tag at every place."""
        if not sentences:
            return []
        known = Words(self.weights)
        numbers = known.numbers([w for s in sentences for w in s])
        first = np.zeros(len(numbers), bool)
        first[np.cumsum([0, *map(len, sentences)])[:-1]] = True
        scored = known.emissions(numbers, first)
        return _cut(scored, sentences)

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag path of every sequence; sequences of a like length take a step at once. Ties take the smaller tag."""
        return _cut(self._paths(np.concatenate(emissions), np.array([*map(len, emissions)])), emissions) if emissions else []

    def _paths(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """:meth:`decode` of sequences that lie one after the other."""
        moves, paths = self.steps + self.allowed(), np.zeros(len(emissions), np.int64)

        def run(places: np.ndarray, live: list[int]) -> np.ndarray:
            best, back = places[0] + moves[0], np.zeros(places.shape, np.int64)
            for step in range(1, len(places)):
                through = best[: live[step], :, None] + moves
                back[step, : live[step]] = through.argmax(1)
                best[: live[step]] = through.max(1) + places[step, : live[step]]
            out, tag = np.zeros(places.shape[:2], np.int64), best.argmax(1)
            for step in range(len(places) - 1, -1, -1):
                rows = np.arange(live[step])
                out[step, rows] = tag[rows]
                tag[rows] = back[step, rows, tag[rows]]
            return out

        for at, found in _by_length(emissions, lengths, run):
            paths[at] = found
        return paths

    def certainty(self, emission: np.ndarray) -> np.ndarray:
        """Forward-backward shares of the tags at every place, the scores read as log-linear."""
        return self.certainties([emission])[0]

    def certainties(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """:meth:`certainty` of every sequence."""
        return _cut(self._shares(np.concatenate(emissions), np.array([*map(len, emissions)])), emissions) if emissions else []

    def _shares(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """:meth:`certainties` of sequences that lie one after the other."""
        moves, shares = self.steps + self.allowed(), np.zeros_like(emissions)

        def run(places: np.ndarray, live: list[int]) -> np.ndarray:
            ahead, behind = np.zeros_like(places), np.zeros_like(places)
            ahead[0] = places[0] + moves[0]
            for step in range(1, len(places)):
                n = live[step]
                ahead[step, :n] = places[step, :n] + np.logaddexp.reduce(ahead[step - 1, :n, :, None] + moves, axis=1)
            for step in range(len(places) - 2, -1, -1):
                n = live[step + 1]
                behind[step, :n] = np.logaddexp.reduce(moves + places[step + 1, :n, None] + behind[step + 1, :n, None], axis=2)
            joint = ahead + behind
            return np.exp(joint - np.logaddexp.reduce(joint, axis=2)[..., None])

        for at, found in _by_length(emissions, lengths, run):
            shares[at] = found
        return shares

    def spans(self, texts: list[str | None], known: Words | None = None, scored: bool = True) -> tuple[np.ndarray, ...]:
        """Text, start, end, number of the label and score of every span of whole texts.

        The score is the least share of the span's tags; it is left at 1 unless ``scored``.
        """
        known = Words(self.weights) if known is None else known
        cut = [_PIECES.findall(t or "") for t in texts]
        pieces = [p for c in cut for p in c]
        numbers = known.numbers(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(texts)), [*map(len, cut)])
        chars = np.array([len(t or "") for t in texts], np.int64)
        start = np.cumsum(sizes) - sizes - (np.cumsum(chars) - chars)[owner]
        kind = known.kind[numbers]
        at = np.flatnonzero(kind == 0)
        if not len(at):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))
        marks, first = np.cumsum(kind == 1)[at], np.ones(len(at), bool)
        first[1:] = (marks[1:] != marks[:-1]) | (owner[at[1:]] != owner[at[:-1]])
        lengths = np.diff(np.append(np.flatnonzero(first), len(at)))
        emissions = known.emissions(numbers[at], first)
        path = self._paths(emissions, lengths)
        tagged = np.logical_or.reduceat(path > 0, np.flatnonzero(first))
        held = np.flatnonzero(np.repeat(tagged, lengths))
        share = self._shares(emissions[held], lengths[tagged])[np.arange(len(held)), path[held]] if scored else np.ones(len(held))
        # An I only stands behind the B or I of its label, so a span is a B and what follows of the words tagged.
        share, held = share[path[held] > 0], held[path[held] > 0]
        opens = np.flatnonzero(path[held] % 2 == 1)
        if not len(opens):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))
        head, tail = at[held[opens]], at[held[np.append(opens[1:], len(held)) - 1]]
        return owner[head], start[head], start[tail] + sizes[tail], path[held[opens]] // 2, np.minimum.reduceat(share, opens)

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, label, score) spans of whole texts, as :meth:`spans` finds them."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for n, a, b, label, share in zip(*(c.tolist() for c in self.spans(texts)), strict=True):
            out[n].append((a, b, self.labels[label], share))
        return out


def gold_path(places: list[tuple[int, int]], spans: Spans, labels: Sequence[str]) -> np.ndarray:
    """Tags of one sequence's words from labelled spans of the text."""
    path, open_span = np.zeros(len(places), np.int64), None
    for n, (a, b) in enumerate(places):
        held = next((s for s in spans if s[0] <= a and b <= s[1]), None)
        if held:
            path[n] = (2 if held == open_span else 1) + 2 * labels.index(held[2])
        open_span = held
    return path


def _best_path(emission: list[list[float]], moves: list[list[float]]) -> list[int]:
    """:meth:`Tagger.decode` of one sequence, in plain numbers."""
    tags = range(len(moves))
    best, back = [e + m for e, m in zip(emission[0], moves[0], strict=True)], []
    for own in emission[1:]:
        now, came = [], []
        for j in tags:
            most, by = best[0] + moves[0][j], 0
            for i in tags[1:]:
                if (value := best[i] + moves[i][j]) > most:
                    most, by = value, i
            now.append(most + own[j])
            came.append(by)
        best = now
        back.append(came)
    path = [max(tags, key=best.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def fit(rows: list[tuple[str, Spans]], labels: Sequence[str], epochs: int = 5, seed: int = 1) -> Tagger:
    """Train on labelled texts by the averaged structured perceptron (numpy, on the driver).

    The sample's bound is set where it is drawn (:func:`dictionary_sample`). The
    average is kept as the current weights minus a running, time-weighted sum of
    updates. Without rows every word is tagged O.
    """
    model = Tagger.blank(labels)
    weight_sum, step_sum, now = np.zeros_like(model.weights), np.zeros_like(model.steps), 1
    data = []
    for text, spans in rows:
        for places in sequences(text):
            slots = np.array(place_slots([text[a:b] for a, b in places]))
            data.append((slots, gold_path(places, spans, labels)))
    rng, allowed = np.random.default_rng(seed), model.allowed()
    for _ in range(epochs):
        for n in rng.permutation(len(data)):
            slots, gold = data[n]
            path = np.array(_best_path(model.weights[slots].sum(1).tolist(), (model.steps + allowed).tolist()))
            for k in np.flatnonzero(path != gold):
                for tag, sign in ((gold[k], 1.0), (path[k], -1.0)):
                    np.add.at(model.weights, (slots[k], tag), sign)
                    np.add.at(weight_sum, (slots[k], tag), sign * now)
            for k in range(len(gold)) if (path != gold).any() else ():
                before, guessed = (gold[k - 1], path[k - 1]) if k else (0, 0)
                if (before, gold[k]) != (guessed, path[k]):
                    model.steps[before, gold[k]] += 1
                    model.steps[guessed, path[k]] -= 1
                    step_sum[before, gold[k]] += now
                    step_sum[guessed, path[k]] -= now
            now += 1
    return Tagger(tuple(labels), model.weights - weight_sum / now, model.steps - step_sum / now)


def join_overlaps(spans: Spans) -> Spans:
    """Maximal runs of overlapping spans, under the first one's label."""
    out: Spans = []
    for a, b, label in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, label))
    return out


def dictionary_sample(
    texts: DataFrame, lexicon: DataFrame, label: str, key: str = "note_id", rows: int = 400, chars: int = 4000
) -> list[tuple[str, Spans]]:
    """Labelled rows from dictionary hits: ``rows`` texts chosen by a checksum of their text and key, of a
    longer one ``chars`` characters from a place its checksum chooses. These two bound what comes to the driver.
    """
    mark = F.crc32(F.concat_ws(":", F.col(key).cast("string"), "text").cast("binary"))
    at = F.when(F.length("text") > chars, mark % (F.length("text") - chars + 1)).otherwise(0).cast("int")
    chosen = (
        texts.where(F.length("text") > 0).select(F.col(key), mark.alias("_m"), F.substring(F.col("text"), at + 1, F.lit(chars)).alias("text"))
        .orderBy("_m", key).limit(rows).select(F.monotonically_increasing_id().alias("_row"), "text")
    )
    held = {r._row: r.text for r in chosen.collect()}
    spark = texts.sparkSession
    again = spark.createDataFrame(list(held.items()), "_row long, text string")
    spans: dict[int, Spans] = {row: [] for row in held}
    for h in tag_terms(again, lexicon, keep=("_row",)).select("_row", "start", "end").collect():
        spans[h._row].append((h.start, h.end, label))
    return [(held[row], join_overlaps(s)) for row, s in sorted(spans.items())]


def scorer(model: Tagger) -> Callable[[list[str]], list[list[dict]]]:
    """The model as a batch scorer of E3."""

    def score(texts: list[str]) -> list[list[dict]]:
        return [
            [{"text": text[a:b], "label": label, "score": share} for a, b, label, share in spans]
            for text, spans in zip(texts, model.tag(texts), strict=True)
        ]

    return score


def tag_texts(texts: DataFrame, model: Tagger, key: str = "note_id", text: str = "text", scored: bool = True) -> DataFrame:
    """E3 with E7's offsets: (key, start, end, label, score) of every span of whole texts, one pass, no shuffle.

    The model travels with the tasks; its size is SLOTS x tags, not the corpus's. Null
    and empty texts have no spans, repeated rows repeat theirs. Unless ``scored`` all scores are 1.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(sent.value.weights)
        labels = pa.array(sent.value.labels, pa.string())
        for batch in batches:
            reach = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // CHARS
            ends = [*np.flatnonzero(reach[1:] != reach[:-1]) + 1, batch.num_rows]
            for at, end in zip([0, *ends], ends):
                part = batch.slice(at, end - at)
                owner, starts, stops, label, share = sent.value.spans(part.column(1).to_pylist(), known, scored)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32)), labels.take(pa.array(label)), pa.array(share)],
                    names=[key, "start", "end", "label", "score"],
                )

    return texts.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, start int, end int, label string, score double")
