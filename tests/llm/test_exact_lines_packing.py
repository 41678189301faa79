import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartweave.llm import exact, lines, packing
from chartweave.llm.packing import tokenizer_path

ROWS = [
    (4, "a b c", None), (2, "abc", "x"), (3, " a\tb\x0bc ", "x"), (7, None, "x"), (6, "", None), (5, " \n", None),
    (2, "abc", "x"), (None, "abd", None), (8, "xyz" * 5000, None), (9, "xyz " * 5000, None), (10, "xyz" * 4999 + "xyy", None),
    (11, "é" * 7, None), (12, "a\x00b c", None),
]


def _docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, name string")


def brute_exact(rows):
    groups = {}
    for n, (d, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, n))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        keep = rows[best[3]][0]
        stays = 0
        for m in sorted(members):
            kept = m == best and not stays
            stays += kept
            out[rows[m[3]][0], keep, len(members), kept, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def _verdicts(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_equals_brute_force(spark, block):
    assert _verdicts(exact.exact_dedup(_docs(spark), block)) == brute_exact(ROWS)


def test_exact_tells_colliding_blocks_apart(spark):
    weak = lambda b: F.pmod(F.xxhash64(b), F.lit(2))
    rows = [(i, t, None) for i, t in enumerate(["abcdef", "abcxyz", "abc def", "xyzabc", "ab", "ab ", "", "abcdefg", "abcdeff", "qrs"] * 2)]
    assert _verdicts(exact.exact_dedup(_docs(spark, rows), 3, weak)) == brute_exact(rows)


def test_drop_copies_keeps_one_row_each(spark):
    left = exact.drop_copies(_docs(spark))
    assert left.columns == ["doc_id", "text", "name"]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "5", "None", "9", "10", "11", "12"])
    assert exact.drop_copies(_docs(spark, [(1, "t", "x"), (1, "t", "x")])).count() == 1
    assert exact.exact_dedup(_docs(spark, [])).count() == 0 and exact.drop_copies(_docs(spark, [])).count() == 0


def brute_lines(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for d, t, *_ in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if found[key(x)] < least]
        out[d, len(parts), len(parts) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (5, 3)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = [(i % 9, t, None) for i, t in enumerate(["Top\nbody %d\nEND " % (i // 2) for i in range(14)] + [
        None, "", "\n\n", "top", "É\né\né", "é", "\x0btop\nTOP\nx\n", "a\n" * 3000 + "top"])]
    df = lines.dedup_lines(_docs(spark, rows), 3, batches, fanout)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()) == brute_lines(rows, 3)


def test_lines_of_an_empty_table(spark):
    assert lines.dedup_lines(_docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_bins_hold_the_histogram(histogram):
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    groups = packing.configure_bins(lengths, counts, 40)
    held = Counter()
    for n, held_lengths in groups:
        assert n > 0 and sum(held_lengths) <= 40
        for x in held_lengths:
            held[x] += n
    assert held == histogram
    # No worse than best-fit decreasing by more than a bin in ten.
    plain = sum(n for n, _ in packing.best_fit([], lengths, counts, 40))
    assert sum(n for n, _ in groups) <= plain + max(1, plain // 10)


def test_words_give_the_tokenizers_ids():
    words = packing.WordTokens(tokenizer_path())
    for text in ["a <|endoftext|> b<|startoftext|>c", "É é x ́y", "a b c\x0bd\x1ce\x85f", "don't 'S x's 12 3", "İ ﬃ ß ſ", "中文 测试，",
                 "ΑΣ ΟΔΟΣ.", "a\x00b \x07", "x" * 5000, "…,.;!?", "Ǆ ʼn ÿ Ĳ", ""]:
        ids = list(struct.unpack(f"<{len(words.ids(text)) // 4}I", words.ids(text)))
        assert ids == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def _check_pack(rows, packed, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    place = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place.get(r.sequence_id, 0)
        place[r.sequence_id] = r.offset + r.length
    assert not place or max(place.values()) <= capacity
    return place


def test_pack_odd_rows(spark, monkeypatch):
    rows = [(1, None, "x"), (2, "", None), (3, "word " * 9000, None), (None, "a b", None), (4, "same", None), (4, "same", None)] + [
        (10 + i, "tok " * (i % 11), "n") for i in range(60)]
    monkeypatch.setattr(packing, "RANKED", 5)
    _check_pack(rows, packing.pack(_docs(spark, rows), tokenizer_path(), 64).collect(), 64)
    assert packing.pack(_docs(spark, []), tokenizer_path()).count() == 0


def test_pack_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    packed = entry.queries()["op3_best_fit_packing"](spark, folder).collect()
    place = _check_pack(rows, packed, 4096)
    assert len(place) <= -(-sum(r.length for r in packed) // 4096) + 1
