"""Substring deduplication by sliding sentence spans."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import let_go, row_key, same_row, small_batches
from chartweave.session import materialise

#: Sentences and words a span has at least; a sentence of ``ALONE`` words is a span of its own.
SENTENCES, WORDS, ALONE = 2, 20, 40

#: Words from which a sentence is cut at its commas and from which a clause is cut further; words of a window,
#: after whose word of least checksum it is cut.
LONG, CLAUSE, WINDOW = 16, 16, 12

_COMMA, _WORD = re.compile(r"[,;:]\s+"), re.compile(r"\S+\s*")
_END = re.compile(r"[.!?]+[\"')\]»”]*\s+|\s*\n\s*")

SPANS = "doc_id long, text_key long, at int, n int, h long, g int, known boolean"
COVERED = "doc_id long, text_key long, at int, n int"
CLEANED = "doc_id long, n_sentences long, n_removed long, n_spans long, text string"


def _cut(text: str, ends: list[int]) -> list[str]:
    cuts = [0, *ends] if not ends or ends[-1] == len(text) else [0, *ends, len(text)]
    if not ends and text:
        cuts = [0, len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def least_words(words: list[str], window: int = WINDOW) -> list[int]:
    """Places of the words whose checksum is the least of some window of ``window`` words, ties all counting.

    A window's choice depends on its own words only, so a passage chooses the same
    words wherever it stands, at least one of every ``window`` of them.
    """
    sums = [zlib.crc32(w.strip().lower().encode()) for w in words]
    out, low, last = [], -1, -1
    for at in range(len(sums) - window + 1):
        new = at + window - 1
        if last < at:  # the least so far has left the window
            low = min(sums[at : new + 1])
            out += [k for k in range(at, new + 1) if sums[k] == low]
            last = out[-1]
        elif sums[new] <= low:
            low, last = sums[new], new
            out.append(new)
    return out


def sentences(text: str | None) -> list[str]:
    """Pieces of a text, each with the white space after it; together they are the text.

    A piece is a sentence. A long one is cut at its commas, and what is long still
    after the words of :func:`least_words`. Where cuts fall depends on what stands
    there, so a passage set into another sentence is cut as it was before but for
    its ends.
    """
    out = []
    for sentence in _cut(text or "", [m.end() for m in _END.finditer(text or "")]):
        if len(sentence.split()) < LONG:
            out.append(sentence)
            continue
        for clause in _cut(sentence, [m.end() for m in _COMMA.finditer(sentence)]):
            words = list(_WORD.finditer(clause))
            if len(words) < CLAUSE:
                out.append(clause)
            else:
                out += _cut(clause, [words[i].end() for i in least_words([w[0] for w in words])])
    return out


def spans(pieces: list[str], least: int = SENTENCES, words: int = WORDS, alone: int = ALONE) -> list[tuple[int, int, memoryview]]:
    """(first sentence, sentences, key) of the shortest spans that start and that end at every sentence.

    A sentence of ``alone`` words is a span of its own; any other starts and ends a
    shortest run of ``least`` or more sentences with ``words`` or more words. Every
    longer run is a union of such spans within it, so where it is repeated they are,
    and removing theirs removes every repeated run whole. A span depends on nothing
    outside itself. Keys are words with one space between them, A-Z lower-cased,
    and a line end between sentences.
    """
    keys = [p.encode().lower().split() for p in pieces]
    if not keys:
        return []
    sizes = np.array([len(k) for k in keys])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    joined = [b" ".join(k) for k in keys]
    text = memoryview(b"\n".join(joined))
    at_byte = np.concatenate([[0], np.cumsum([len(j) + 1 for j in joined])])
    here = np.arange(len(keys))
    # Where the run that starts at a sentence ends, and where the one that ends with it starts.
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + words, "left"), here + least)
    starts = np.minimum(np.searchsorted(upto, upto[1:] - words, "right") - 1, here + 1 - least)
    single = sizes >= alone
    forward, backward = ~single & (ends <= len(keys)), ~single & (starts >= 0)
    backward &= single[starts] | (ends[starts] != here + 1)  # not the forward run of its first sentence
    first = np.concatenate([here[single], here[forward], starts[backward]])
    last = np.concatenate([here[single] + 1, ends[forward], here[backward] + 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return [
        (a, b - a, text[x:y])
        for a, b, x, y in zip(first.tolist(), last.tolist(), at_byte[first].tolist(), (at_byte[last] - 1).tolist(), strict=True)
    ]


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Null flag, doc_id, text key and first piece: the order of places, column by column."""
    doc = batch.column("doc_id")
    return (
        doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False),
        batch.column("text_key").to_numpy(zero_copy_only=False), batch.column("at").to_numpy(zero_copy_only=False),
    )


def _runs(*keys: np.ndarray) -> np.ndarray:
    """For every row the first row of its run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def span_rows(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, alone: int = ALONE) -> DataFrame:
    """Every span of every whole text as :data:`SPANS`; h and g are 96 bits of its hash.

    Of a span that a batch holds at several places all but the first are known to be
    repeats. They are marked and dealt by their place, so a span that very many
    documents share sends on one row a batch.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            # Documents in the order of places, so that rows are in it too and a stable sort by hash keeps it.
            batch = batch.sort_by([("doc_id", "ascending"), ("text_key", "ascending")])
            found = [spans(sentences(t.as_py()), least, words, alone) for t in batch.column(2)]
            repeats = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64))
            digests = b"".join([xxh3_128_digest(key)[:12] for f in found for _, _, key in f])
            hashes = np.frombuffer(digests, np.dtype([("h", ">u8"), ("g", ">u4")]))
            hashes = np.stack([hashes["h"].astype(np.uint64), hashes["g"].astype(np.uint64)], axis=1)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0).take(repeats), batch.column(1).take(repeats),
                 pa.array([s[0] for f in found for s in f], pa.int32()), pa.array([s[1] for f in found for s in f], pa.int32()),
                 pa.array(hashes[:, 0].view(np.int64)), pa.array(hashes[:, 1].astype(np.uint32).view(np.int32))],
                names=["doc_id", "text_key", "at", "n", "h", "g"],
            )
            place = _places(out)
            order = np.lexsort((hashes[:, 1], hashes[:, 0]))
            first = order[_runs(hashes[order, 0], hashes[order, 1])]
            known = np.zeros(len(order), bool)
            known[order] = np.logical_or.reduce([c[order] != c[first] for c in place])
            spread = place[2].view(np.uint64) + place[3].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = np.where(known, spread, hashes[:, 0]).view(np.int64)
            yield out.set_column(4, "h", pa.array(h)).append_column("known", pa.array(known))

    return docs.select(*row_key(), "text").mapInArrow(run, SPANS)


def repeated(rows: DataFrame) -> DataFrame:
    """Places of spans that are not their span's first, as :data:`COVERED`.

    One exchange by hash; a sorted stream shows each span's first place before the
    others, so nothing is held but the last span seen.
    """
    place = [F.col("doc_id").asc_nulls_last(), "text_key", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            columns = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "known")), *_places(batch)]
            if not len(columns[0]):
                continue
            if last is not None:  # the run that the batch before ended with goes on in front
                columns = [np.concatenate([a, b]) for a, b in zip(last, columns, strict=True)]
            first = _runs(*columns[:3])
            hit = columns[2] | np.logical_or.reduce([c != c[first] for c in columns[3:]])
            skip = len(columns[0]) - batch.num_rows
            last = [c[first[-1] : first[-1] + 1] for c in columns]
            yield batch.select(["doc_id", "text_key", "at", "n"]).filter(pa.array(hit[skip:]))

    dealt = rows.repartition("h", "g").sortWithinPartitions("h", "g", "known", *place)
    return dealt.mapInArrow(run, COVERED)


def dedup_spans(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, alone: int = ALONE) -> DataFrame:
    """Remove every piece (see :func:`sentences`) that a repeated run of ``docs`` (doc_id, text) covers, but for its first place.

    The first place is the one of the smallest doc_id (null last), then the least
    sentence; repeats within a document go as well. A null or empty text has no
    sentences and stays empty; a text of one very long sentence is a span of its own.
    Rows that repeat doc_id and text are one document: what one loses the other
    does. Other columns are ignored; an empty table gives an empty result.

    Returns doc_id, n_sentences (pieces), n_removed (pieces), n_spans (runs of removed
    sentences) and text (what stays).
    """
    found = materialise(repeated(span_rows(docs, least, words, alone)))
    let_go(docs.sparkSession)
    covered = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    own = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    joined = own.join(covered, same_row(own, covered), "left").select(
        own["doc_id"], "text", F.col("runs.at").alias("at"), F.col("runs.n").alias("n")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string()]
        for batch in batches:
            rows = []
            for text, at, n in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                pieces = sentences(text.as_py())
                gone = np.zeros(len(pieces) + 1, np.int64)
                if at.is_valid:
                    starts, sizes = at.values.to_numpy(), n.values.to_numpy()
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + sizes, -1)
                gone = np.cumsum(gone)[:-1] > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(pieces), int(gone.sum()), runs, "".join([p for p, g in zip(pieces, gone, strict=True) if not g])))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=[c.split()[0] for c in CLEANED.split(", ")],
            )

    return joined.mapInArrow(run, CLEANED)
