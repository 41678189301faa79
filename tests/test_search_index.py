"""Searches over posting lists against a scan of every row."""

from pyspark.sql import functions as F

from chartweave.operators.search_index import SearchIndex, query_grams, text_grams

ROWS = [
    (1, "Acute FEVER of unknown origin", "Dr Roy"), (2, None, "fever"), (3, "", ""), (4, "fev er", None), (5, "ab", "abc"), (5, "second row, same key", "x"),
    (6, "100% of a_b\\c", "Straße ÉTÉ"), (7, "ΣΑΣ σας", "İstanbul 😀😀😀"), (None, "fever without key", None), (8, "x" * 30_000 + " hidden needle", "y"), (9, "aaaa", "aaa bbb"),
]
QUERIES = ["fever", " FEVER ", "", "ab", "abc", "er o", "f%r", "fe_er", "a\\\\_b", "été", "ÉTÉ", "σας", "istanbul", "😀😀😀", "needle", "nowhere at all", "aaaa", "xxxx", "same KEY", "aaa bbb ccc"]


def test_search_equals_scan(spark, tmp_path):
    table = spark.createDataFrame([(k, a, b, "clash") for k, a, b in ROWS], "id long, a string, b string, gram string")
    index = SearchIndex.build(table, str(tmp_path / "index"), "id", ["a", "b"])
    want = set()
    for q in {q.strip() for q in QUERIES}:
        hit = F.lit(not q) | F.coalesce(F.col("a").ilike(f"%{q}%"), F.lit(False)) | F.coalesce(F.col("b").ilike(f"%{q}%"), F.lit(False))
        want |= {(q, r.id) for r in table.where(hit & F.col("id").isNotNull()).collect()}
    rows = [(r.query, r.id) for r in index.search(QUERIES).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert index.search([]).count() == 0 and index.search(["nowhere at all"]).count() == 0
    plan = index.search(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan  # the lists are read once, for the candidates


def test_empty_table_and_grams(spark, tmp_path):
    index = SearchIndex.build(spark.createDataFrame([], "id long, a string"), str(tmp_path / "index"), "id", ["a"])
    assert index.search(["fever", "", "a"]).count() == 0
    assert query_grams("Fe_ver%abcd") == ["abc", "bcd", "ver"] and query_grams("ab") == [] and query_grams("aΣbcd") == ["bcd"]


def test_grams_of_a_text_are_those_of_its_characters(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "A\nB c", "a\U0001f600bc", "\U0001f600", "\u00c9t\u00e9 \u4e2d\u6587"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for row in df.select("t", text_grams(F.col("t")).alias("g")).collect():
        low = (row.t or "").lower()
        assert sorted(row.g or []) == sorted({low[i : i + 3] for i in range(len(low) - 2)})


def test_grams_are_cut_by_one_pattern(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(text_grams(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
