"""Values, negation, time, pages and errors on small facts."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.basis import Basis
from factloom.operators.store import Store, correct, end, replace
from factloom.plans import ast as A
from factloom.plans import catalog
from factloom.plans import explain as X
from factloom.plans.errors import CommitError, CursorError, UnboundVariable, UnknownAttribute, ValidationError
from factloom.sources.facts import FactBase, Lift, LiftedTable, lift

DAY = 86_400_000


def fact(e, a, v, **more):
    return {"op": "assert", "entity": e, "attribute": a, "value": v, "validFrom": 0, **more}


@pytest.fixture(scope="module")
def families(spark, tmp_path_factory):
    """A bakery's stock: amounts, moments and labels that look alike but are of different kinds."""
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s", clock=lambda: 1000)
    s.transact(
        [
            fact("loaf:1", ":stock/label", "0450"), fact("loaf:1", ":stock/grams", 450), fact("loaf:1", ":stock/fresh", False), fact("loaf:1", ":stock/baked", {"type": "datetime", "value": 90_000}), fact("loaf:1", ":stock/mix", {"type": "json", "value": {"rye": 2, "oat": 1}}), fact("loaf:1", ":stock/oven", {"type": "ref", "value": "450"}),
            fact("tin:a", ":tin/holds", 450), fact("tin:b", ":tin/holds", "450"), fact("tin:c", ":tin/holds", 900), fact("order:1", ":order/wants", 450), fact("order:2", ":order/wants", "450"), fact("order:3", ":order/wants", True),
            fact("s1", ":scale/shows", 12.5), fact("s2", ":scale/shows", {"type": "datetime", "value": 30}), fact("s3", ":scale/shows", 30), fact("s4", ":scale/shows", "30"), fact("s5", ":scale/shows", 31), fact("s6", ":scale/shows", "light"),
        ],
        actor="user:a",
    )
    return s


def ask(s, find, where, basis=None, **more):
    rows = s.query({"find": find, "where": where, **more}, basis).collect()
    plain = lambda x: next((p for p in (x["num"], x["bool"], x["txt"]) if p is not None), None) if hasattr(x, "asDict") else x
    return sorted((tuple(plain(x) for x in r) for r in rows), key=str)


def test_projection_keeps_families(families):
    got = dict(ask(families, ["?a", "?v"], [["loaf:1", "?a", "?v"]]))
    assert got == {":stock/label": "0450", ":stock/grams": 450.0, ":stock/fresh": False, ":stock/baked": 90_000.0, ":stock/mix": '{"oat":1,"rye":2}', ":stock/oven": "450"}


def test_joins_and_predicates_by_family(families):
    assert ask(families, ["?t", "?o"], [["?t", ":tin/holds", "?v"], ["?o", ":order/wants", "?v"]]) == [("tin:a", "order:1"), ("tin:b", "order:2")]
    of = lambda op, v: [r[0] for r in ask(families, ["?e"], [["?e", ":scale/shows", "?v"], [op, "?v", v]])]
    assert of("=", 30) == ["s2", "s3"] and of("=", "30") == ["s4"]
    assert of("!=", 30) == ["s1", "s4", "s5", "s6"]
    assert of(">=", 30) == ["s2", "s3", "s5"] and of("<", 30) == ["s1"]
    assert ask(families, ["?e"], [["?e", ":scale/shows", {"type": "datetime", "value": 30}]]) == [("s2",)]
    assert ask(families, ["?e"], [["?e", ":stock/oven", {"type": "string", "value": "450"}]]) == []
    assert ask(families, ["?e"], [["?e", ":stock/oven", "450"]]) == [("loaf:1",)]


def test_distinct_and_bag(families):
    assert ask(families, ["?n", "?s"], [["?e", ":scale/shows", "?v"]], aggregate=[["count", "?v", "?n"], ["sum", "?v", "?s"]]) == [(5, 103.5)]
    assert len(ask(families, ["?v"], [["?e", ":scale/shows", "?v"]])) == 5


def test_time(spark, tmp_path):
    """Twelve plots of a garden: a crop each for some weeks, every fourth for good; one bed is planned by one hand and replanned by another."""
    now = [40 * DAY]
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: now[0])
    plots = [(f"plot:{i}", ("kale", "leek", "bean")[i % 3], 7 * i * DAY, None if i % 4 == 0 else (7 * i + 20) * DAY) for i in range(12)]
    sow = lambda e, v, a, b: fact(e, ":plot/crop", v, validFrom=a, **({} if b is None else {"validTo": b}))
    s.transact([sow(*p) for p in plots], actor="hand:ada")
    planned = s.transact([fact("bed", ":bed/plan", "beet", validFrom=10 * DAY, validTo=50 * DAY)], actor="hand:bo")
    s.transact([fact("bed", ":bed/plan", "beet", validFrom=10 * DAY, validTo=90 * DAY), {"op": "retract", "id": planned.ids[0]}], actor="hand:cy")
    for day in (0, 21, 45, 200):
        want = sorted((e, v) for e, v, a, b in plots if a <= day * DAY and (b is None or b > day * DAY))
        assert ask(s, ["?e", "?v"], [["?e", ":plot/crop", "?v"]], Basis(valid_at=day * DAY)) == want
    soon = [{"pattern": ["?e", ":plot/crop", "?v"], "valid": {"to": "?end"}}, [">", "?end", 40 * DAY], ["<=", "?end", 56 * DAY]]
    want = sorted((e, float(b)) for e, _, a, b in plots if a <= 40 * DAY and b is not None and 40 * DAY < b <= 56 * DAY)
    assert want and ask(s, ["?e", "?end"], soon, Basis(valid_at=40 * DAY)) == want
    who = [["?b", ":bed/plan", "beet", "?tx"], ["?tx", ":_tx/actor", "?who"]]
    assert [ask(s, ["?who"], who, Basis(position=p, valid_at=12 * DAY)) for p in (1, 2, 3)] == [[], [("hand:bo",)], [("hand:cy",)]]
    span = [{"pattern": ["bed", ":bed/plan", "?v"], "valid": {"from": "?a", "to": "?b"}}]
    assert [ask(s, ["?a", "?b"], span, Basis(position=p), validTime="all") for p in (2, 3)] == [[(10.0 * DAY, 50.0 * DAY)], [(10.0 * DAY, 90.0 * DAY)]]
    assert ask(s, ["?a", "?b"], span, Basis(position=3, valid_at=90 * DAY)) == []
    with pytest.raises(ValidationError):
        s.query({"find": ["?v"], "where": [["bed", ":bed/plan", "?v"]], "validTime": "all"}, Basis(valid_at=0))
    # A retraction that lies behind a cut doesn't show in it.
    assert s.facts().where(f"id = '{planned.ids[0]}' AND retracted_position = 3").count() == 1


def test_pages_are_stable(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 2000)
    r = s.transact([fact(f"e{i:02d}", ":c/due", {"type": "datetime" if i % 2 == 0 else "number", "value": i}) for i in range(1, 24)] + [fact("t", ":c/due", "0"), fact("b", ":c/due", False)])
    q = {"inner": {"find": ["?e", "?d"], "where": [["?e", ":c/due", "?d"]]}, "orderBy": [{"variable": "?d", "direction": "desc"}], "limit": 9, "includeCount": True}
    one = s.page(q)
    s.transact([{"op": "retract", "id": r.ids[0]}, fact("new", ":c/due", 5)])
    two = s.page({**q, "cursor": one.cursor})
    three = s.page({**q, "cursor": two.cursor})
    rows = one.rows + two.rows + three.rows
    assert one.total == 25 and three.cursor is None
    assert [x["d"] for x in rows] == [float(i) for i in range(23, 0, -1)] + [False, "0"]
    for cursor, code in (("x", "malformed"), (one.cursor, "query_mismatch")):
        with pytest.raises(CursorError) as e:
            s.page({**q, "limit": 8, "cursor": cursor})
        assert e.value.code == code


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ({"find": ["?x"], "where": [["?e", ":a", "?v"]]}, UnboundVariable),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"], [">", "?z", 1]]}, UnboundVariable),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"], [">", "?v", "x"]]}, ValidationError),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"], ["and", ["?e", ":b", 1]]]}, ValidationError),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"], ["or", [[["?e", ":b", 1], ["?e", ":c", 1]]]]]}, ValidationError),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"], ["not"]]}, ValidationError),
        ({"find": ["?e", "?n"], "where": [["?e", ":a", "?v"]], "aggregate": [["count", "?e", "?n"]]}, ValidationError),
        ({"find": ["?e"], "where": [["r", "?e", "?x"]]}, ValidationError),
        ({"find": ["?e"], "where": [{"pattern": ["?e", ":a", "?v"], "valid": {"from": 5, "to": 5}}]}, ValidationError),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"]], "limit": 0}, ValidationError),
        ({"find": ["?e"], "where": [["?e", ":a", "?v"]], "bogus": 1}, ValidationError),
        ({"find": ["?e"], "where": [["r", "?e", "?x"]], "rules": [{"name": "r", "body": [["r", "?a", "?b"], ["?b", ":p", "?c"]]}]}, ValidationError),
    ],
)
def test_errors(query, error):
    with pytest.raises(error):
        A.parse(query)


def test_dependencies():
    d = A.dependencies({"find": ["?e"], "where": [["a", ":x", "?e"], ["not", ["?e", ":y", 1]], ["?e", "?any", 2]]})
    assert d["attributes"] == {":x", ":y"} and d["dynamic"] and d["subjects"] == {":x": {"a"}, ":y": None} and d["ids"] == {"a"}


def test_interval_edits():
    f = {"id": "f", "entity": "e", "attribute": ":a", "value": {"type": "number", "value": 1}, "validFrom": 0, "validTo": 9}
    assert [o["op"] for o in replace(f, 2, 5)] == ["retract", "assert", "assert"]
    assert end(f, 5)[1]["validTo"] == 5 and correct(f, 3)[1]["value"]["value"] == 3


def test_history_at_every_cut(spark, tmp_path):
    """A generated history against a plain list, at each position and moment."""
    s, state, log, tick = Store(spark, f"file://{tmp_path}/s", clock=lambda: tick[0]), 7, [], [100]

    def rnd(n):
        nonlocal state
        state = (state * 1664525 + 1013904223) % 2**32
        return state // 65536 % n

    live = []
    for step in range(1, 7):
        tick[0] += 10
        ops = []
        if live and rnd(2):
            ops.append({"op": "retract", "id": live.pop(rnd(len(live)))})
        for _ in range(2):
            a = rnd(100)
            ops.append({"op": "assert", "entity": f"e{rnd(2)}", "attribute": ":h/v", "value": rnd(5), "validFrom": a, **({"validTo": a + 1 + rnd(50)} if rnd(2) else {})})
        r = s.transact(ops)
        for i, op in zip(r.ids, [o for o in ops if o["op"] == "assert"], strict=True):
            log.append([i, op, step, None])
        live += r.ids
        for x in log:
            if x[0] in r.retracted:
                x[3] = step
    for position in (1, 3, 6):
        for valid_at in (10, 60, 140):
            want = sorted({(o["entity"], float(o["value"])) for _, o, p, g in log if p <= position and (g is None or g > position) and o["validFrom"] <= valid_at and (o.get("validTo") is None or o["validTo"] > valid_at)})
            assert ask(s, ["?e", "?v"], [["?e", ":h/v", "?v"]], Basis(position=position, valid_at=valid_at)) == want


def test_commands_and_preconditions(families):
    n = families.head()
    with pytest.raises(CommitError) as e:
        families.transact([fact("loaf:1", ":stock/label", "x")], preconditions=[{"kind": "AttributeAbsent", "entity": "loaf:1", "attribute": ":stock/label"}])
    assert e.value.code == "precondition" and families.head() == n
    with pytest.raises(CommitError):
        families.transact([fact("loaf:1", ":_tx/actor", "x")])
    with pytest.raises(CommitError):
        families.transact([{"op": "assert", "entity": "e", "attribute": ":a", "value": 1, "validFrom": 0.5}])
    with pytest.raises(CommitError):
        families.transact([fact("e", ":a", float("nan"))])


def test_unknown_attributes_have_a_suggestion(families):
    base = families.base()
    base.known = {":stock/label", ":stock/grams", ":tin/holds"}
    for attribute, hint in ((":stock/grmas", ":stock/grams"), (":stock/lable", ":stock/label"), (":oven/heat", None)):
        with pytest.raises(UnknownAttribute) as e:
            base.query({"find": ["?e"], "where": [["?e", ":tin/holds", 450], ["not", ["?e", attribute, "?v"]]]})
        assert e.value.more["suggestion"] == hint and e.value.path == "where[1]"
    assert base.query({"find": ["?e"], "where": [["?e", ":tin/holds", 450], ["?t", ":_tx/position", "?p"]]}).count() == 1


def test_explain(families):
    base, q = families.base(), {"find": ["?e"], "where": [["?e", ":scale/shows", "?v"], [">", "?v", 1], ["not", ["?e", ":tin/holds", "?x"]]]}
    got = X.explain(base, q)
    assert got["clauses"] == {"patterns": 1, "predicates": 1, "negations": 1, "disjunctions": 0, "rule_calls": 0, "rules": 0, "aggregates": 0}
    assert "LeftAnti" in got["steps"][0][1]
    assert [n for n, _ in X.explain_page(base, {"inner": q, "includeCount": True})["steps"]] == ["main", "count"]
    assert X.debug(base, q)["rows"] == 4


def test_distinct_only_where_rows_may_repeat(spark, sf_dir):
    base = catalog.lifted(spark, sf_dir, "orders", "customer")
    plan = lambda find, where, **more: X.explain(base, {"find": find, "where": where, **more})["steps"][0][1]
    order, of = ["?o", ":order/total", "?t"], ["?o", ":order/customer", "?c"]
    assert "Aggregate" not in plan(["?o", "?t"], [order])
    assert "Aggregate" not in plan(["?o", "?n"], [of, ["?c", ":customer/name", "?n"]])  # a row of orders meets one customer
    assert "Aggregate" in plan(["?t"], [order])
    assert "Aggregate" in plan(["?c", "?n"], [of, ["?c", ":customer/name", "?n"]])
    assert "distinct" not in plan(["?t", "?n"], [order], aggregate=[["count", "?o", "?n"]])


def test_rules_from_bound_values(spark):
    df = spark.createDataFrame([(i, i * 2 + k) for i in range(1, 40) for k in (0, 1)] + [(90, 91), (91, 92), (92, 90)], "a int, b int")
    facts = [("n:%d" % a, "n:%d" % b) for a, b in {(r.a, r.b) for r in df.collect()}]
    nodes = spark.createDataFrame(facts, "x string, y string")
    table = LiftedTable(nodes, F.col("x"), {":n/next": Lift(F.col("y"), "ref")}, unique=False)
    base = FactBase(spark, [lift(spark.createDataFrame([(2,), (90,), (17,)], "n int"), "start", F.col("n"), at="n:ref:n"), table])
    rules = [{"name": "reach", "maxDepth": 6, "body": [["?x", ":n/next", "?y"]]}, {"name": "reach", "maxDepth": 6, "body": [["?x", ":n/next", "?z"], ["reach", "?z", "?y"]]}]

    def reach(x, depth):
        seen, level = set(), {x}
        for _ in range(depth + 1):
            level = {b for a, b in facts if a in level}
            seen |= level
        return seen

    got = base.query({"find": ["?s", "?y"], "where": [["?s", ":start/at", "?x"], ["reach", "?x", "?y"]], "rules": rules}).collect()
    assert {tuple(r) for r in got} == {(f"start:{n}", y) for n in (2, 90, 17) for y in reach(f"n:{n}", 6)}
    got = base.query({"find": ["?s", "?x"], "where": [["?s", ":start/at", "?y"], ["reach", "?x", "?y"]], "rules": rules}).collect()
    assert {tuple(r) for r in got} == {(f"start:{n}", x) for n in (2, 90, 17) for x in {a for a, _ in facts} if f"n:{n}" in reach(x, 6)}
