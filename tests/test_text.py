"""Micro fixtures for texts, personal data, segments and negation."""

import math
import random
import re

import pytest
from chartweave import fixed_values as V
from chartweave.functions import dates, text
from chartweave.operators import attributes, entities, language, negation, phi, scanner, segments, tagger
from pyspark.sql import functions as F


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_running_starts_and_sentences_partition_text(spark):
    rng = random.Random(1)
    alphabet = "ab é.!?\n,'0"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 700))),) for _ in range(60)] + [("word " * 900,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(
        "t", text.sentence_spans(F.col("t")).alias("s"), text.pieces(F.col("t")).alias("p"),
        text.running_starts(F.transform(text.pieces(F.col("t")), F.length)).alias("o"),
    ).collect()
    for r in got:
        assert "".join(s.sentence for s in r.s) == r.t and "".join(r.p) == r.t
        for s in r.s:
            assert r.t[s.start:].startswith(s.sentence)
        at = 0
        for p, o in zip(r.p, r.o):
            assert o == at
            at += len(p)


def test_sentence_keeps_decimals(spark):
    got = one(spark, "Temp 38.5 C. Fine!\nNext", lambda c: F.transform(text.sentence_spans(c), lambda s: s["sentence"]))
    assert got == ["Temp 38.5 C. ", "Fine!\n", "Next"]


def test_dates(spark):
    cases = {
        "01/02/2015": "2015-02-01", "13/13/2015": None, "3/25/85": "1985-03-25", "2015-3-4": "2015-03-04", "March 3, 2018": "2018-03-03",
        "Mar 3, 2018": "2018-03-03", "12/03/85": "1985-03-12", "[**2015-3-4**]": "2015-03-04", "x": None, "": None, "05.06.2011": "2011-06-05",
        "12-25-2010": "2010-12-25", "2011/7/8": "2011-07-08",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", dates.parse_date(F.col("t")).cast("string").alias("d")).collect():
        assert r.d == cases[r.t], r.t


def test_language_tie_is_french_and_model_rules(spark):
    df = spark.createDataFrame(
        [("", None, None), ("The patient denies pain, unremarkable", None, None), ("x" * 60, "es", None), ("x" * 60, "fr", "en")],
        "text string, m string, f string",
    )
    assert [r.language for r in language.route_language(df, "text", "m", "f").collect()] == ["fr", "en", "en", "en"]


def test_redaction_longest_first(spark):
    rules = [("PATIENT", r"name (\w+ \w+)"), ("DOCTOR", r"Dr (\w+)")]
    df = spark.createDataFrame([("name Ana Lopez saw Dr Ana. Ana Lopez left", "fr")], "text string, language string")
    r = phi.redact(df, "text", {"fr": rules}).first()
    assert r.clean_text == "name [PATIENT] saw Dr [DOCTOR]. [PATIENT] left"
    m = phi.redact(df, "text", {"fr": rules}).select(phi.phi_map(F.col("phi")).alias("m")).first().m
    assert m == {"PATIENT": ["Ana Lopez"], "DOCTOR": ["Ana"]}


def test_reference_patterns_find_french_fields(spark):
    note = "Patient : Jean Dupont\nDr Martin Noir\nné le 01/02/2010, demeurant à Oran, Tél : 0555 12 34 56\nDossier : 12345\nCHU Nord Ville,"
    found = {(s.category, s.value) for s in one(spark, note, lambda c: phi.phi_array(c))}
    assert ("DATE", "01/02/2010") in found and ("LOCATION", "Oran") in found and ("ID", "12345") in found
    assert any(c == "DOCTOR" and v.startswith("Martin") for c, v in found)
    assert ("HOSPITAL", "Nord Ville") in found and ("PHONE", "0555 12 34 56") in found


def test_english_spans_redacted_by_offset(spark):
    notes = spark.createDataFrame([("n", "Seen Ana Lopez at home", "en")], "note_id string, text string, language string")
    spans = spark.createDataFrame(
        [("n", "NAME", "Ana", 5, 8), ("n", "NAME", "Lopez", 9, 14), ("n", "ODD", "home", 18, 22)],
        "note_id string, category string, value string, start int, end int",
    )
    r = phi.redact(notes, "text", {"fr": V.PHI_PATTERNS}, spans=spans).first()
    assert r.clean_text == "Seen [NAME] at home"


def _find_ana(texts):
    if len(texts) > 1 and any("boom" in t for t in texts):
        raise RuntimeError("batch")
    if "boom" in texts[0]:
        raise ValueError("bad text")
    return [[{"text": "Ana", "label": "nom de personne", "score": 0.9, "start": m.start()} for m in re.finditer("Ana", t)] for t in texts]


def test_scorer_reads_whole_notes_and_reports_failing_texts(spark):
    long = "x " * 900 + "Ana" + " y" * 900 + " Ana"
    notes = spark.createDataFrame(
        [("a", "Ana here", "en"), ("b", "boom Ana", "en"), ("c", long, "en"), ("d", None, "en"), ("e", "", "en")], "note_id string, text string, language string"
    )
    spans = phi.score_phi(notes, _find_ana, chunk_chars=100, overlap=20)
    got = sorted((r.note_id, r.category, r.start, r.end, r.error) for r in spans.collect() if r.note_id != "b")
    assert got == [("a", "PATIENT", 0, 3, None), ("c", "PATIENT", 1800, 1803, None), ("c", "PATIENT", 3604, 3607, None)]
    assert [(r.category, r.start, r.end, r.error) for r in spans.where("note_id = 'b'").collect()] == [(None, 0, 8, "ValueError: bad text")]
    clean = {r.note_id: r.clean_text for r in phi.redact(notes, "text", {}, spans=spans).collect()}
    assert clean["a"] == "[PATIENT] here" and "Ana" not in clean["c"] and clean["b"] == "boom Ana" and clean["e"] == ""
    own = spark.createDataFrame([("a", "NAME", "Zed", 0)], "note_id string, category string, value string, seq int")
    merged = {(r.note_id, r.category, r.value) for r in phi.merge_phi(own, spans).collect()}
    assert merged == {("a", "NAME", "Zed"), ("a", "PATIENT", "Ana"), ("c", "PATIENT", "Ana")}


def _find_codes(texts):
    return [[{"text": m[0], "label": "lieu", "score": 0.9, "start": m.start()} for m in re.finditer(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", x)] for x in texts]


def test_values_at_the_edges_of_pieces_are_whole(spark):
    rng = random.Random(5)
    texts = ["w" * shift + " 123.456.789.123" * 60 for shift in range(24)]
    texts += ["".join(rng.choice(["1.22.333.44", "10.200.3.4 ", " ", "word", "\n", "abcdefghijklm"]) for _ in range(200)) for _ in range(20)]
    texts += ["w" * shift + "x".join(["123.45.67.189"] * 60) for shift in range(14)]
    notes = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "note_id string, text string")
    spans = phi.score_phi(notes, _find_codes, chunk_chars=200, overlap=60)
    got = sorted((int(r.note_id), r.start, r.value) for r in spans.collect())
    assert got == sorted((i, s["start"], s["text"]) for i, t in enumerate(texts) for s in _find_codes([t])[0])


def test_notes_without_rules_or_spans_can_be_dropped_or_refused(spark):
    notes = spark.createDataFrame([("a", "raw", "en")], "note_id string, text string, language string")
    assert phi.redact(notes).first().clean_text == "raw" and phi.redact(notes, unruled="drop").first().clean_text is None
    with pytest.raises(Exception, match="no rules and no spans"):
        phi.redact(notes, unruled="error").collect()


def test_span_fusion_and_blocks_agree(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3):
        pos = 0
        for _ in range(60):
            pos += rng.randint(0, 6)
            end = pos + rng.randint(1, 5)
            rows.append((f"n{k}", "A", pos, end, f"<{pos}>"))
            pos = end
    df = spark.createDataFrame(rows, "note_id string, category string, start int, end int, value string")
    plain = {(r.note_id, r.start): r.island for r in phi.span_islands(df, ["note_id"], 2).collect()}
    blocked = {(r.note_id, r.start): r.island for r in phi.span_islands(df, ["note_id"], 2, block=9).collect()}
    assert plain == blocked
    fused = phi.fuse_phi_spans(df).where("note_id = 'n0'").orderBy("start").collect()
    assert "".join(r.value for r in fused) == "".join(v for n, _, _, _, v in rows if n == "n0")
    assert all(b.start - a.end > 2 for a, b in zip(fused, fused[1:]))


def test_attributes(spark):
    info = lambda t, lang: one(spark, t, lambda c: attributes.patient_info(c, F.lit(lang)))
    assert info("Sex: m", "en").sex == "male"
    assert (info("a 34 yo F", "en").sex, info("a 34 yo F", "en").age) == ("female", 34)
    assert info("3 weeks old", "en").age_unit == "weeks"
    fr = info("nourrisson masculin âgé de 7 mois", "fr")
    assert (fr.sex, fr.age, fr.age_unit) == ("male", 7, "months")
    assert info("rien", "fr").sex is None


def test_filename_attributes(spark):
    got = one(spark, "DURAND PAUL 18-11-2025 DR NOIR.docx", attributes.filename_attributes)
    assert (got.patient_name, got.doctor_name, str(got.report_date)) == ("Durand Paul", "Noir", "2025-11-18")
    got = one(spark, "Blanc_Zoe_DIP_Mars2026_Dr_Noir_recu_9.docx", attributes.filename_attributes)
    assert got.patient_name == "Blanc Zoe" and got.pathology == "DIP" and got.doctor_name == "Noir"


def test_fragments_and_offsets(spark):
    words = {"wis": True, "rash": False, "onia": False, "cystx": True, "Abcd": True, "fever": False, "stri": True}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.f for r in df.select("w", entities.is_fragment(F.col("w")).alias("f")).collect()} == words
    assert one(spark, " hy ##per  ##tension ", entities.repair_subwords) == "hypertension"
    notes = spark.createDataFrame([("n", "Pain then pain. PAIN")], "note_id string, text string")
    spans = spark.createDataFrame(
        [("n", 0, i, t, "s") for i, t in enumerate(["pain", "Pain", "pain", "pain", "gone"])],
        "note_id string, chunk_id int, seq int, text string, source string",
    )
    got = [(r.start, r.end) for r in entities.assign_offsets(spans, notes).orderBy("seq").collect()]
    assert got == [(0, 4), (10, 14), (16, 20), (0, 4), (0, 4)]


def test_chunks_never_empty(spark):
    notes = spark.createDataFrame([("n", "one two three four. a b. c d e. f")], "note_id string, text string")
    got = [r.chunk for r in segments.chunks(notes, limit=3).orderBy("chunk_id").collect()]
    assert got == ["one two three four.", "a b.", "c d e.", "f"]


def _reference_negation(sentence, start, end, cues):
    """Fresh brute force over patterns."""
    bound = lambda c: re.compile(r"\b" + re.escape(c) + ("" if c.endswith("'") else r"\b"))
    before, after = sentence[:start], sentence[end:]
    if any(bound(c).search(before) for c in cues.pseudo):
        return None
    fine = lambda b: len(b.split()) <= 6 and not any(bound(x).search(b) for x in cues.terminators)
    for c in cues.pre:
        if any(fine(before[m.end():].strip()) for m in bound(c).finditer(before)):
            return c, "pre"
    for c in cues.post:
        m = bound(c).search(after)
        if m and fine(after[: m.start()].strip()):
            return c, "post"
    return None


def test_negation_examples(spark):
    rows = [("No cough or fever, but rash.", w) for w in ("cough", "fever", "rash")]
    rows += [("No change in tremor.", "tremor"), ("Tremor was ruled out.", "tremor"), ("known abnormal gait", "gait")]
    df = spark.createDataFrame(rows, "s string, w string").withColumn("language", F.lit("en"))
    at = F.call_function("instr", F.lower("s"), F.col("w"))
    df = df.withColumn("before", F.substring("s", F.lit(1), at - 1)).withColumn("after", F.substring("s", at + F.length("w"), F.length("s")))
    got = {r.w + str(i): (r.negated, r.negation_cue, r.negation_confidence) for i, r in enumerate(negation.assert_negation(df).collect())}
    assert got["cough0"] == (True, "no", 0.92) and got["fever1"][0] and not got["rash2"][0]
    assert not got["tremor3"][0] and got["tremor4"] == (True, "was ruled out", 0.699) and not got["gait5"][0]


def test_negation_matches_brute_force(spark):
    rng = random.Random(5)
    for lang in ("en", "fr"):
        cues = negation.CUES[lang]
        vocab = list(cues.pre) + list(cues.post) + list(cues.pseudo) + list(cues.terminators) + ["abc", "xyz,", "nord", "d'eau", "(k)", "a  b"] * 20
        rows = []
        for _ in range(150):
            left = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6))) + " "
            right = " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6)))
            rows.append((left, right))
        df = spark.createDataFrame(rows, "before string, after string").withColumn("language", F.lit(lang))
        for r in negation.assert_negation(df).collect():
            s = r.before + "target" + r.after
            want = _reference_negation(s, len(r.before), len(r.before) + 6, cues)
            assert (r.negation_cue, r.negation_type) == (want or (None, None)), s


def test_scan_matches_brute_force(spark):
    rng = random.Random(7)
    words = ["aa", "bb", "cc", "dd", "é"]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))) for _ in range(40)} | {"aa-bb cc", "aaaa", "dd (é"})
    lookup = [(t, f"C{i % 17}", t, "exact_label") for i, t in enumerate(terms)]
    texts = [(f"n{i}", "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", "-", "  "]) for _ in range(40)).upper()) for i in range(25)]
    texts.append(("n99", "xx aaaa dd (é) aaaab"))
    got = {}
    lk = spark.createDataFrame(lookup, "term string, concept_id string, name string, match_type string")
    notes = spark.createDataFrame(texts, "note_id string, clean_text string")
    for r in scanner.scan(notes, lk).collect():
        got.setdefault(r.note_id, set()).add((r.start, r.end, r.term))
    usable = [x for x in lookup if len(x[0]) >= 6 or (len(x[0].split()) == 1 and len(x[0]) >= 4)]
    for nid, t in texts:
        low, seen, spans, want = t.lower(), set(), [], set()
        for term, cid, _, _ in sorted(usable, key=lambda x: (-len(x[0]), x[0])):
            if cid in seen:
                continue
            for m in re.finditer(r"\b" + re.escape(term) + r"\b", low):
                if any(m.start() < e and m.end() > s for s, e in spans):
                    continue
                spans.append(m.span())
                seen.add(cid)
                want.add((*m.span(), term))
                break
        assert got.get(nid, set()) == want, nid


def test_tagger_finds_every_bounded_occurrence(spark):
    rng = random.Random(9)
    terms = ["ab", "ab cd", "cd", "é-b", "(ab", "cd)", "b, ab"]
    texts = [(i, "".join(rng.choice(["ab", "cd", "é", "b", "(", ")", "-", " ", ", "]) for _ in range(60))) for i in range(30)]
    lex = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.id, r.start, r.term) for r in tagger.tag_terms(spark.createDataFrame(texts, "id int, text string"), lex, keep=("id",)).collect()}
    want = set()
    for i, t in texts:
        for term in terms:
            for m in re.finditer(r"(?=\b" + re.escape(term) + r"\b)", t):
                want.add((i, m.start(), term))
    assert got == want


def test_tagger_reads_a_text_once_and_tests_terms_in_place(spark):
    rng = random.Random(10)
    texts = [(i, "".join(rng.choice(["ab", "Cd", "é", "b", "(", "-", " ", ", "]) for _ in range(rng.choice([0, 1, 2, 60])))) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    for terms in (["ab", "ab cd", "cd", "é-b", "(ab", "b, ab"], ["ab", "ab cd", "cd-"], ["(", " "]):
        lex = spark.createDataFrame([(t,) for t in terms], "term string")
        want = {(i, m.start(), term) for i, t in texts if t for term in terms for m in re.finditer(r"(?=\b" + re.escape(term) + r"\b)", t.lower())}
        for literal_terms in (0, 10_000):
            hits = tagger.tag_terms(df, lex, keep=("id",), literal_terms=literal_terms)
            assert {(r.id, r.start, r.term) for r in hits.collect()} == want, (terms, literal_terms)
            assert hits._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_sentences_are_cut_once(spark):
    df = spark.createDataFrame([(1, "One. Two e.g. three. Four")], "id int, text string")
    known = spark.createDataFrame([("e.g",)], "type string")
    for rows in (segments.sentences(df, "text", ("id",)), segments.learned_sentences(df, known, "text", ("id",))):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.sentence for r in rows.orderBy("sentence_id").collect()] == ["One. ", "Two e.g. three. ", "Four"]


def test_learned_sentences_of_a_long_text_take_linear_time(spark):
    import time

    df = spark.createDataFrame([(1, "ab cd e.g. fg. " * 30_000)], "id int, text string")
    known = spark.createDataFrame([("e.g",)], "type string")
    began = time.monotonic()
    assert segments.learned_sentences(df, known, "text", ("id",)).count() == 30_000
    assert time.monotonic() - began < 40  # 1.8 billion steps if every sentence walks the text again


def test_overlap_fusion_and_dedup(spark):
    rows = [("n", "p", 0, "a", 0.9, 0, 10), ("n", "p", 1, "b", 0.8, 1, 10), ("n", "p", 2, "c", 0.7, 9, 20)]
    df = spark.createDataFrame(rows, "note_id string, category string, seq int, text string, score double, start int, end int")
    assert sorted(r.text for r in entities.fuse_overlaps(df).collect()) == ["a", "c"]
    d = spark.createDataFrame([("n", "p", 0, "Rash"), ("n", "p", 1, "rash"), ("n", "p", 2, " rash "), ("n", "p", 3, "ab")], "note_id string, category string, seq int, text string")
    assert sorted(r.seq for r in entities.dedup_mentions(d).collect()) == [0, 2, 3]
    assert [r.seq for r in entities.dedup_mentions(d, longest=True, min_chars=3).collect()] == [2]
    assert [r.seq for r in entities.dedup_mentions(d, longest=True, min_chars=3, hot_keys=True).collect()] == [2]


def _punkt(texts, least=0.3):
    """Abbreviations by plain counting."""
    counts = {}
    for text in texts:
        for tok in re.split(r"\s+", (text or "").lower()):
            tok = re.sub(r"[^\w.]+$", "", re.sub(r"^[^\w]+", "", tok))
            ends = re.search(r"[^.]\.$", tok) is not None
            kind = tok[:-1] if ends else tok
            if any(c.isalpha() for c in kind):
                k, n = counts.get(kind, (0, 0))
                counts[kind] = (k + ends, n + (not ends))
    p = sum(k for k, _ in counts.values()) / sum(k + n for k, n in counts.values())
    out = {}
    for kind, (k, n) in counts.items():
        size, inner = len(kind.replace(".", "")), kind.count(".")
        ratio = 2 * (k * math.log(0.99) + n * math.log(0.01) - k * math.log(p) - n * math.log(1 - p))
        score = ratio * math.exp(-size) * (inner + 1) * size**-n
        if k and score >= least:
            out[kind] = round(score, 6)
    return out


def test_learned_abbreviations_and_sentences(spark):
    word = ["fever", "cough", "meals", "sleep", "early", "sore", "left", "calm", "weak", "pain"]
    texts = [
        f"Seen by Dr. Martin with {word[i % 10]} and {word[(i + 3) % 10]}. The boy (p.ex. at night) has {word[(i + 1) % 10]}, e.g. after {word[(i + 7) % 10]}. Mr. Roy saw {word[(i + 4) % 10]}. He felt {word[(i + 5) % 10]}."
        for i in range(30)
    ]
    texts += ["Dose was 5 mg. Then nothing.", None, "", "One. Two. One two three early and left a lot.", "No end here at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string")
    known = segments.abbreviations(docs)
    got = {r.type: round(r.score, 6) for r in known.collect()}
    assert got == pytest.approx(_punkt(texts)) and {"dr", "mr", "p.ex", "e.g"} <= set(got) and not set(word) & set(got)
    plain = {}
    for r in segments.sentences(docs).orderBy("note_id", "sentence_id").collect():
        plain.setdefault(r.note_id, []).append(r.sentence)
    want = []
    for note, own in plain.items():
        merged = []
        for s in own:
            last = re.search(r"([^\s(]+)\.\s*$", merged[-1]) if merged else None
            if last and last[1].lower() in got:
                merged[-1] += s
            else:
                merged.append(s)
        at = 0
        for n, s in enumerate(merged):
            want.append((note, n, at, at + len(s), s))
            at += len(s)
    for rows in (100, 1):
        found = segments.learned_sentences(docs, known, literal_rows=rows)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert segments.learned_sentences(docs, known.limit(0)).count() == sum(map(len, plain.values()))
    assert segments.abbreviations(docs.limit(0)).count() == 0


def test_language_scores_lower_a_text_once_for_all_markers(spark):
    from chartweave import fixed_values as V
    from chartweave.operators.language import language_scores

    texts = [None, "", "ÉTAT GÉNÉRAL " + "é " * 9, "le la les un une des le chat", "Chief complaint: DENIES pain", "Hospitalisation; examen clinique"]
    notes = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "note_id int, text string")
    scored = language_scores(notes)
    hits = lambda t, markers: sum(m in (t or "").lower() for m in markers)
    for r in scored.collect():
        low = (r.text or "").lower()
        accents = sum(c in V.FRENCH_ACCENTS[1:-1] for c in low) > V.ACCENT_LIMIT
        articles = sum(w in ("le", "la", "les", "un", "une", "des", "du", "au", "aux") for w in low.split()) > V.ARTICLE_LIMIT
        assert r.fr_score == hits(r.text, V.FRENCH_MARKERS) + V.ACCENT_POINTS * accents + V.ARTICLE_POINTS * articles
        assert r.en_score == hits(r.text, V.ENGLISH_MARKERS)
    # A marker's test holds a lowered text; lowering it there did so for every marker.
    assert "contains(lower(" not in scored._jdf.queryExecution().analyzed().toString().lower()
