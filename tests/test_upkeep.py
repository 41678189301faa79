"""Changes applied to an ontology against a full rebuild."""

import random

from chartweave.operators.ontology import ancestor_closure, information_content
from chartweave.operators.upkeep import Ontology, apply_signed, update_closure

EDGE, NOTE = "child string, parent string", "disease_id string, concept_id string"


def brute_closure(edges):
    up = {n: set() for e in edges for n in e}
    for c, p in edges:
        up[c].add(p)
    out = set()
    for n in up:
        todo, seen = [n], {n}
        while todo:
            more = up[todo.pop()] - seen
            seen |= more
            todo += more
        out |= {(n, a) for a in seen}
    return out


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_closure_after_changes(spark):
    rng = random.Random(5)
    for trial in range(3):
        names = [f"t{n}" for n in range(14)]
        held = {tuple(sorted(rng.sample(names, 2), key=lambda n: int(n[1:]), reverse=True)) for _ in range(18)}
        gone = set(rng.sample(sorted(held), 5)) | {("t99", "t98")}
        come = {(f"t{rng.randrange(7, 18)}", f"t{rng.randrange(0, 7)}") for _ in range(4)} | {("t20", "t3"), ("t21", "t20")}
        table = spark.createDataFrame(sorted(held), EDGE)
        changes = spark.createDataFrame([(*e, -1) for e in gone] + [(*e, 1) for e in come] + [(None, "t1", 1), ("t1", None, -1)], EDGE + ", sign int")
        old = ancestor_closure(table)
        edges, closure, delta = update_closure(table, old, changes)
        want = (held - gone) | come
        assert pairs(edges) == want and pairs(closure) == brute_closure(want), trial
        assert {tuple(r) for r in delta.collect()} == {(*p, 1) for p in brute_closure(want) - brute_closure(held)} | {(*p, -1) for p in brute_closure(held) - brute_closure(want)}


def test_content_equals_rebuild_and_no_change_changes_nothing(spark):
    edges = [("a", "m"), ("b", "m"), ("b", "n"), ("m", "r"), ("n", "r"), ("a", "m"), (None, "r")]
    notes = [("d1", "a"), ("d1", "unknown"), ("d2", "b"), ("d3", "n"), ("d3", "n"), (None, "a"), ("d4", None)]
    state = Ontology.build(spark.createDataFrame(edges, EDGE), spark.createDataFrame(notes, NOTE))
    same = state.changed(spark.createDataFrame([], EDGE + ", sign int"), spark.createDataFrame([], NOTE + ", sign int"))
    assert pairs(same.information_content()) == pairs(state.information_content())
    after = state.changed(
        spark.createDataFrame([("b", "n", -1), ("a", "n", 1), ("n", "r", -1)], EDGE + ", sign int"),
        spark.createDataFrame([("d2", "b", -1), ("d5", "a", 1), ("d3", "n", -1), ("d3", "n", 1), ("d6", "x", -1)], NOTE + ", sign int"),
    )
    full = Ontology.build(after.edges, after.annotations)
    assert pairs(after.edges) == {("a", "m"), ("b", "m"), ("m", "r"), ("a", "n")}
    assert after.diseases == full.diseases == 3 and pairs(after.counts) == pairs(full.counts) and pairs(after.reach) == pairs(full.reach)
    assert pairs(after.information_content()) == pairs(information_content(after.annotations, full.closure))
    # A second round of changes on the first one's result.
    again = after.changed(spark.createDataFrame([("n", "r", 1)], EDGE + ", sign int"), spark.createDataFrame([], NOTE + ", sign int"))
    assert pairs(again.counts) == pairs(Ontology.build(again.edges, again.annotations).counts)
    both = apply_signed(spark.createDataFrame([("a", "b")], EDGE), spark.createDataFrame([("a", "b", -1), ("a", "b", 1), ("c", "d", 0)], EDGE + ", sign int"))
    assert pairs(both) == {("a", "b")}
