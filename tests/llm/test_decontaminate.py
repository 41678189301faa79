import itertools
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chartweave.llm import decontaminate as d


def brute_tiles(item, doc, shortest):
    free_i, free_d, tiles = [True] * len(item), [t != 0 for t in doc], []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
        if best[2] < shortest:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            free_i[best[0] + k] = free_d[best[1] + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=14), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 4))
def test_tiles_equal_brute_force(item, doc, shortest):
    got = d.greedy_tiles(np.array(item, np.uint64), np.array(doc, np.uint64), shortest)
    assert got == brute_tiles(item, doc, shortest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abcx"), max_size=16))
def test_candidates_equal_brute_force(items, doc):
    index = d.BenchmarkIndex([(n, " ".join(i)) for n, i in enumerate(items)], 3)
    tokens = np.array([index.vocabulary.get(w.encode(), 0) for w in doc], np.uint64)
    want = {}
    for n, item in enumerate(i for i in items if i):
        size, held = min(3, len(item)), set()
        for at in range(len(item) - size + 1):
            if any(doc[k : k + size] == item[at : at + size] for k in range(len(doc))):
                held.update(range(at, at + size))
        if held:
            want[n] = len(held)
    assert index.candidates(tokens) == want


def test_one_repeated_word_makes_no_pairs():
    index = d.BenchmarkIndex([(1, "word " * 500), (2, "word " * 400 + "other")])
    started = time.process_time()
    assert sorted(index.held("word " * 100_000, 0.8)) == [(1, 500, 500, 1), (2, 401, 400, 1)]
    assert time.process_time() - started < 10


def test_windows_compare_across_texts():
    a, b = np.array([7, 1, 2, 3], np.uint64), np.array([5, 5, 9, 1, 2, 3, 4], np.uint64)
    assert d.window_hashes(a, 3)[1] == d.window_hashes(b, 3)[3]
    assert len(d.window_hashes(a, 5)) == 0


ITEM = "one two three four five six seven eight nine ten"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, coverage string")


def test_finds_whole_reordered_and_partial(spark):
    docs = _docs(spark, [
        (1, f"Before. {ITEM.upper()}, after.", None, "x"),
        (2, "six seven eight nine ten and then ONE two three, four five", "q", None),
        (3, "one two three four five six seven eight", None, None),
        (4, "one two three four five six seven x eight nine ten", None, None),
        (5, "one two three four and six seven eight nine", None, None),
        (6, None, None, None), (7, "", None, None), (8, "word " * 50_000 + ITEM, None, None),
        (1, f"Before. {ITEM.upper()}, after.", None, "x"), (None, ITEM, None, None),
    ])
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, " .,"), (4, "short item")], "item_id long, text string")
    found = d.contaminated(docs, bench)
    got = sorted((str(r.doc_id), r.item_id, r.covered_words, r.tiles) for r in found.collect())
    assert got == [("1", 1, 10, 1), ("1", 1, 10, 1), ("2", 1, 10, 2), ("3", 1, 8, 1), ("8", 1, 10, 1), ("None", 1, 10, 1)]
    parts = d.contaminated(docs, bench, index_words=3)
    assert sorted((str(r.doc_id), r.item_id, r.covered_words, r.tiles) for r in parts.collect()) == got
    left = d.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7]


def test_short_items_match_whole(spark):
    docs = _docs(spark, [(1, "a short item here", None, None), (2, "short of item", None, None)])
    bench = spark.createDataFrame([(4, "Short item")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()] == [(1, 4)]


def test_empty_tables(spark):
    docs, bench = _docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    full = _docs(spark, [(1, ITEM, None, None)])
    assert d.contaminated(docs, bench).count() == 0 and d.contaminated(full, bench).count() == 0
    assert d.drop_contaminated(full, bench).count() == 1


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id): round(r.coverage, 6) for r in entry.queries()["op1_decontamination"](spark, folder).collect()}
    bench = [(r.item_id, d.words_of(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = d.words_of(r.text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words))}
        for item_id, item in bench:
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                held = [words.index(w) + 1 if w in words else -1 for w in item]
                tiles = d.greedy_tiles(np.array(held, np.int64).astype(np.uint64), np.array([words.index(w) + 1 for w in words], np.uint64))
                share = sum(t[2] for t in tiles) / len(item)
                if share >= 0.8:
                    want[r.doc_id, item_id] = round(share, 6)
    assert got == want and got
