"""Best-fit packing by a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import small_batches
from chartweave.session import materialise

#: The tokenizer of the query and of the pipeline.
TOKENIZER = "word_bpe_49k.json"
#: Tokens of a sequence, and the id that ends every document.
CAPACITY, END_ID = 4096, 1
#: Rounds of the multiplicative-weights solver and the step of its prices.
ROUNDS, STEP = 12, 0.02
#: Pieces of one length that are numbered in one task.
RANKED = 100_000
#: Words a worker remembers.
REMEMBERED = 400_000
#: The pre-token pattern of ``word_bpe_49k.json``, read only to split words for the cache.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class WordTokens:
    """Token ids of a text, word by word, with a bounded memory of words.

    No token of this vocabulary spans white space, so a text's ids are those of its
    words in order. Plain words go to the tokenizer's model by pre-token; words with
    letters beyond Latin or with marks of special tokens go to the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.split, self.letters = self.tokenizer.model, regex.compile(PRE_TOKEN), _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            self.parts[part] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not text.isprintable() or not text.isascii() and not (
            max(text) <= "ſ" and "İ" not in text and unicodedata.is_normalized("NFC", text)
        ):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            low = text.lower()
            ids = self._part(low) if low.isalpha() else b"".join(map(self._part, self.split.findall(low)))
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        get, learn = self.words.get, self._word
        return b"".join([found if (found := get(w)) is not None else learn(w) for w in text.encode().split()])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents as token counts, cut into pieces of ``capacity`` where they are longer.

    Whole texts are tokenized; the ids stay in the task, their length and checksum leave.
    """
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies; it is installed on every node and never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


Group = tuple[int, tuple[int, ...]]


def _priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack dynamic program: the dearest filling of every capacity at the given prices."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        if n := upto[room]:
            best[room] = max(best[room - 1], (best[room - lengths[:n]] + prices[:n]).max())
    return best


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> dict[tuple[int, ...], float]:
    """Fractional use of configurations that covers the histogram, by multiplicative weights.

    A length's price starts at its share of a sequence. In every round a knapsack
    dynamic program prices all capacities; each length that lags behind the round's
    schedule leads a configuration completed from that table at the prices of the
    moment. Prices are multiplied down as lengths get ahead and up as they lag, so
    the next fillings use what is left.
    """
    use: dict[tuple[int, ...], float] = {}
    demand, covered = counts.astype(float), np.zeros(len(lengths))
    weights = np.ones(len(lengths))
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for turn in range(1, rounds + 1):
        weights *= np.exp(step * (turn / rounds - covered / demand))
        prices = weights * lengths / capacity
        best = _priced(lengths, prices, capacity)
        for lead in range(len(lengths) - 1, -1, -1):
            for _ in range(4):
                want = demand[lead] * turn / rounds - covered[lead]
                if want <= 1e-9 * demand[lead]:
                    break
                chosen, room, left = [lead], capacity - int(lengths[lead]), demand - covered
                left[lead] -= want
                while n := upto[room]:
                    value = np.where(left[:n] > 1e-6, best[room - lengths[:n]] + prices[:n], 0.0)
                    item = int(value.argmax())
                    if value[item] <= 0:
                        break
                    chosen.append(item)
                    room -= int(lengths[item])
                    left[item] -= want
                items, times = np.unique(np.array(chosen), return_counts=True)
                x = min(want / times[items == lead][0], ((demand - covered)[items] / times).min())
                covered[items] += x * times
                ahead = np.exp(-step * x * times / demand[items])
                weights[items] *= ahead
                prices[items] *= ahead
                name = tuple(sorted((int(lengths[i]) for i in chosen), reverse=True))
                use[name] = use.get(name, 0.0) + x
    return use


def best_fit(groups: list[Group], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing of a histogram into equal bins kept together, starting from open ``groups``."""
    bins: dict[int, list[Group]] = {}
    for n, held in groups:
        bins.setdefault(capacity - sum(held), []).append((n, held))
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r in bins]] = True
    for length, left in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                per = capacity // length
                full, rest = divmod(left, per)
                for n, times in ((full, per), (1, rest)):
                    if n and times:
                        bins.setdefault(capacity - times * length, []).append((n, (length,) * times))
                        rooms[capacity - times * length] = True
                break
            room = int(fits[0]) + length
            n, held = bins[room].pop()
            per = room // length
            if left >= n * per:
                used, times = n, per
            elif left >= per:
                used, times = left // per, per
            else:
                used, times = 1, left
            if used < n:
                bins[room].append((n - used, held))
            elif not bins[room]:
                rooms[room] = False
            bins.setdefault(room - times * length, []).append((used, (*held, *(length,) * times)))
            rooms[room - times * length] = True
            left -= used * times
    return [g for held in bins.values() for g in held]


def configure_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Bins for a histogram of lengths (ascending): (number of equal bins, lengths in each).

    The linear program's uses are rounded down, then up where the demand left
    allows; what remains is packed best-fit into the room left and new bins.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    whole = lengths == capacity
    groups: list[Group] = [(int(n), (capacity,)) for n in counts[whole] if n]
    lengths, counts = lengths[~whole], counts[~whole]
    if not len(lengths):
        return groups
    left, place = counts.copy(), {int(n): i for i, n in enumerate(lengths)}
    use = sorted(solve_lp(lengths, counts, capacity).items(), key=lambda u: (-u[1], u[0]))
    taken: dict[tuple[int, ...], int] = {}
    for up in (False, True):
        for name, x in use:
            if sum(name) < capacity:
                continue
            items, times = np.unique([place[n] for n in name], return_counts=True)
            n = min(1 if up else int(x + 1e-6), int((left[items] // times).min()))
            if n > 0 and (not up or x % 1 > 0.05):
                taken[name] = taken.get(name, 0) + n
                left[items] -= n * times
    groups += best_fit([(n, name) for name, n in taken.items()], lengths[left > 0], left[left > 0], capacity)
    return groups


def _slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """Which ranks of a length go where: rows (length, first rank, sequence, copies per bin, offset)."""
    rows, given, sequence = [], {}, 0
    for n, held in groups:
        offset = 0
        for length in sorted(set(held), reverse=True):
            per = held.count(length)
            rows.append((length, given.get(length, 0), sequence, per, offset))
            given[length] = given.get(length, 0) + n * per
            offset += per * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "per": table[:, 3], "offset": table[:, 4]}


def _ranked(found: DataFrame, total: int) -> DataFrame:
    """Number the pieces of every length from 0; a common length is numbered in many tasks."""
    parts = max(1, -(-total // RANKED))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "part"]).withColumn(
        "rank", F.col("base") + F.col("own")
    ).drop("part", "own", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into as few sequences of at most ``capacity`` tokens as it can.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces of
    ``capacity``, the last of which may be shorter. A null or empty text is its end
    id alone. Repeated rows are packed as often as they stand; a null doc_id is kept.
    Other columns are ignored; an empty table gives an empty result.

    Only the histogram, which has at most ``capacity`` entries however large the
    corpus is, goes to the driver; the table of slots that comes back is bounded by
    the solver's rounds and the number of lengths. Returns the columns of
    :data:`PIECES` with sequence_id and offset.
    """
    spark = docs.sparkSession
    found = materialise(pieces(docs, tokenizer, capacity, end_id))
    histogram = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    slots = spark.sparkContext.broadcast(
        _slots(configure_bins([r["length"] for r in histogram], [r["n"] for r in histogram], capacity))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = slots.value
        at = np.searchsorted(s["key"], (length.to_numpy() << 48) + rank.to_numpy(), side="right") - 1
        past, per = rank.to_numpy() - s["rank"][at], s["per"][at]
        return pd.DataFrame(
            {"sequence_id": s["sequence"][at] + past // per, "offset": s["offset"][at] + past % per * length.to_numpy()}
        )

    ranked = _ranked(found, sum(r["n"] for r in histogram))
    return ranked.withColumn("at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )
