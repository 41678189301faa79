import zlib

import numpy as np

from chartweave.llm import language as l

EN, DE = "the house and the garden of this town", "das Haus und der Garten dieser Stadt für über"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def _rows(n=60):
    return [(i, " ".join(np.roll((EN if i % 2 else DE).split(), i % 7)) * 3, "en" if i % 2 else "de", None) for i in range(n)]


def brute_subwords(letters):
    text, out = bytes(letters), []
    for n in l.GRAMS:
        for at in range(len(text) - n + 1):
            g = text[at : at + n]
            if b" " in g[1:-1]:
                continue
            h = n
            for c in g:
                h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
            out.append((h ^ (h >> 15)) & (l.BUCKETS - 1))
    return sorted(out)


def test_subwords_equal_brute_force_in_any_stretches(monkeypatch):
    letters = l.letters_of("Für 3 Äpfel, a  b\tüber!")
    want = brute_subwords(letters)
    assert sorted(np.concatenate(list(l.subwords(letters))).tolist()) == want
    monkeypatch.setattr(l, "CHUNK", 5)
    assert sorted(np.concatenate(list(l.subwords(letters))).tolist()) == want


def test_learns_without_held_out_rows_and_rejects_what_has_no_letter(spark):
    rows = _rows() + [(1000, None, "en", "x"), (1001, "", None, None), (1002, "12 ½ ² -- !", "de", None), (None, EN, None, None),
                      (3, EN, None, None), (3, EN, None, None), (1006, DE + " x" * 100_000, "xx", None), (1005, EN, "en", None)]
    docs = _docs(spark, rows)
    model = l.fit(docs)
    assert model.langs == ["de", "en", "xx"]  # of the only text of xx a part is learnt
    found = l.predict(docs, model).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1000, 1001, 1002):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].rejected) == ("und", 0.0, True)
    assert by[None][0].lang_pred == by[1005][0].lang_pred == "en" and len(by[3]) == 3
    assert all(0 <= r.score <= 1 for r in found)
    left = l.drop_rejected(docs, model)
    assert left.columns == docs.columns and left.count() == len(rows) - 3
    held = {r.doc_id: r.h for r in docs.select("doc_id", l.held_out(docs.doc_id).alias("h")).collect()}
    assert all(h == (d is None or zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


def test_nothing_to_learn(spark):
    empty = _docs(spark, [])
    model = l.fit(empty)
    assert l.predict(empty, model).count() == 0 and l.drop_rejected(empty, model).count() == 0
    some = _docs(spark, [(1, EN, None, None), (2, "12", None, None), (3, None, "en", None)])
    assert [(r.lang_pred, r.score, r.rejected) for r in l.predict(some, model).orderBy("doc_id").collect()] == [("und", 0.0, False), ("und", 0.0, True), ("und", 0.0, True)]
    assert [r.doc_id for r in l.drop_rejected(some, model).collect()] == [1]


def test_sample_is_bounded_in_rows_characters_and_languages(spark, monkeypatch):
    """Rows that repeat an id, texts beyond the bound, and more languages than are learnt."""
    seen = {}
    monkeypatch.setattr(l, "train", lambda texts, langs: seen.update(texts=texts, langs=langs))
    rows = [(1, f"text {i} of one id", "en", None) for i in range(40)] + [(1, "text 0 of one id", "en", None)] * 30 + [(i, "abcdefghij" * 50, "de", None) for i in range(2, 30)]
    rows += [(100 + i, f"word {i}", f"z{i}", None) for i in range(9)]
    l.fit(_docs(spark, rows), rows=5, chars=30, langs=3)
    assert sorted(set(seen["langs"])) == ["de", "en", "z0"] or len(set(seen["langs"])) == 3
    assert all(seen["langs"].count(x) <= 5 for x in seen["langs"]) and all(len(t) <= 30 for t in seen["texts"])
    parts = {t for t, x in zip(seen["texts"], seen["langs"], strict=True) if x == "de"}
    assert all(t in "abcdefghij" * 50 for t in parts)


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    found = entry.queries()["op6_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert sum(r.rejected for r in rows) <= 5
