"""Constraints, derivations, rules of three values, types, snapshots, sealed values, live queries."""

import time

import pytest
from pyspark.sql import functions as F
from test_queries import fact

from factloom.functions import values as V
from factloom.functions.basis import Basis
from factloom.operators import config as G
from factloom.operators import constraints as C
from factloom.operators import derive as D
from factloom.operators import kleene as K
from factloom.operators import runner as R
from factloom.operators import sealed as X
from factloom.operators import snapshots as N
from factloom.operators import types as T
from factloom.operators.store import Store
from factloom.plans.errors import CommitError, ValidationError
from factloom.streaming.live import Reactor, Registry, Watch, flips, watch

P = lambda e, a, v, **k: fact(e, a, v, entityType="person", **k)
RULES = [C.Required("person", ":p/name"), C.Cardinality("person", ":p/name"), C.Unique("person", ":p/mail"), C.ReferenceTarget("person", ":p/boss", "person")]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('ops')}/s", RULES, clock=lambda: 1000)
    s.transact([P("a", ":p/name", "Ann"), P("a", ":p/mail", "x"), P("b", ":p/name", "Bob"), P("b", ":p/boss", {"type": "ref", "value": "a"})], actor="u1", command_id="c1")
    return s


@pytest.mark.parametrize(
    ("ops", "kind"),
    [
        ([P("c", ":p/mail", "z")], "Required"),
        ([P("a", ":p/name", "Anna", validFrom=5000)], "Cardinality"),
        ([P("c", ":p/name", "Cy"), P("c", ":p/mail", "x", validFrom=9000)], "Unique"),
        ([P("a", ":p/boss", {"type": "ref", "value": "zz"})], "ReferenceTarget"),
    ],
)
def test_constraints_hold_at_every_edge(store, ops, kind):
    with pytest.raises(CommitError) as e:
        store.transact(ops)
    assert {v["kind"] for v in e.value.more["violations"]} == {kind}
    log, broken = store.transact(ops, dry_run=True)
    assert log.count() == len(ops) and broken.count() >= 1


def test_old_violations_are_tolerated(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    s.transact([P("a", ":p/mail", "x")])
    s.constraints = RULES
    s.transact([P("b", ":p/name", "Bob")])
    with pytest.raises(CommitError):
        s.transact([P("c", ":p/mail", "y")])
    s.validators = [lambda before, after: "no" if after.query({"find": ["?e"], "where": [["?e", ":p/name", "Eve"]]}).count() else None]
    with pytest.raises(CommitError):
        s.transact([P("e", ":p/name", "Eve")])


def test_derivation(store):
    d = D.Derivation.make("boss", {"find": ["?e", "?n"], "where": [["?e", ":p/boss", "?b"], ["?b", ":p/name", "?n"]]}, ["?e"], ["?n"])
    base = store.base()
    one = D.candidates(base, d, store.pin())
    r = one.first()
    assert one.count() == 1 and len(r["sources"]) == 2 and not r["conflict"]
    name = next(i for i in r["sources"] if store.get(i).first()["attribute"] == ":p/name")
    other = D.candidates(D.what_if(base, [P("a", ":p/name", "Eva")], [name]), d, store.pin())
    assert [x["change"] for x in D.reconcile(one, other).collect()] == ["changed"]
    assert D.why_candidate(one, store.facts(), r["candidate"]).count() == 2
    with pytest.raises(ValidationError):
        D.Derivation.make("x", {"find": ["?e"], "where": [["?e", "?a", "?v"]]}, ["?e"])


def test_materialisation_goes_stale(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    s.transact([P("a", ":p/name", "Ann", validTo=5000)])
    m = D.Materialized(s, D.Derivation.make("n", {"find": ["?e"], "where": [["?e", ":p/name", "?n"]]}, ["?e"]), f"file://{tmp_path}/m")
    assert m.status() == "unmaterialized"
    m.run()
    assert m.status() == "current" and m.status(5000) == "stale"
    s.transact([P("a", ":p/note", "x")])
    assert m.status() == "current"
    s.transact([P("b", ":p/name", "Bob")])
    assert m.status() == "stale"


def test_three_values(store):
    live = store.facts().where("retracted_position IS NULL")
    rules = {"boss": ("exists", ":p/boss"), "x": ("eq", ":p/mail", "x"), "both": ("all", [("rule", "boss"), ("rule", "x")]), "any": ("any", [("rule", "boss"), ("rule", "x")]), "loop": ("not", ("rule", "loop"))}
    got = {r["entity"]: r.asDict() for r in K.evaluate(live, live.select("entity").distinct(), rules, 0).collect()}
    assert got["a"] == {"entity": "a", "boss": False, "x": True, "both": False, "any": True, "loop": None}
    assert got["b"] == {"entity": "b", "boss": True, "x": None, "both": None, "any": True, "loop": None}
    new = rules | {"x": ("lit", True)}
    assert {(r["entity"], r["rule"]) for r in K.impact(live, live.select("entity").distinct(), rules, new, 0).collect()} == {("b", "x"), ("b", "both")}
    a, b = (K.evaluate(live, live.select("entity").distinct(), {"x": r["x"]}, 0) for r in (rules, new))
    assert flips(a, b).count() == 1


def test_types():
    num, whole, text = T.Prim("number"), T.Prim("integer"), T.Prim("text")
    assert T.relation(whole, num) == "widens" and T.relation(num, whole) == "narrows" and T.relation(num, text) == "incompatible"
    assert T.subsumes(T.Union((num, text)), T.Enum(frozenset({"a"}))) and not T.subsumes(T.Enum(frozenset({"a"})), text)
    assert T.subsumes(T.Bounded(num, min=0), T.Bounded(whole, min=1)) and not T.subsumes(T.Bounded(num, min=0), whole)
    assert T.accepts(T.Record((("a", num, True), ("b", text, False))), {"a": 1}) and not T.accepts(T.ListOf(num), ["x"])


def test_validation_and_snapshots(store):
    live = store.facts().where("retracted_position IS NULL")
    t = T.EntityType("person", (T.Attribute(":p/name", T.Bounded(T.Prim("text"), max_length=2), True), T.Attribute(":p/mail", T.Prim("text"), True)))
    got = {(r["entity"], r["attribute"], r["problem"]) for r in T.validate(live, t).collect()}
    assert got == {("a", ":p/name", "invalid"), ("b", ":p/name", "invalid"), ("b", ":p/mail", "missing"), ("b", ":p/boss", "unknown")}
    assert T.decode(live, t).count() == 2
    without = live.where("entity <> 'b' OR attribute <> ':p/boss'")
    assert [tuple(r) for r in N.diff(live, without).collect()] == [("b", ":p/boss", "removed")]
    assert N.changed(live, without).count() == 1
    h = N.snapshot(live).where("entity = 'a'").first()["hash"]
    assert N.find_by_hash(N.snapshot(without), h).count() == 1


def test_sealed(spark, tmp_path):
    z = X.Sealing(X.Codec("k", lambda t: t[::-1], lambda t: t[::-1], b"key"), {":p/ssn": "string", ":p/pin": "number"})
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    s.transact([P("a", ":p/ssn", z.value(":p/ssn", "123")), P("b", ":p/ssn", z.value(":p/ssn", "123")), P("c", ":p/ssn", z.value(":p/ssn", "9")), P("a", ":p/name", "Ann")])
    ask = lambda where, find=("?e",): sorted(tuple(r) for r in s.base(sealing=z).query({"find": list(find), "where": where}, Basis(valid_at=1)).collect())
    assert ask([["?e", ":p/ssn", "123"]]) == [("a",), ("b",)]
    assert ask([["?e", ":p/ssn", 123]]) == []
    assert ask([["?e", ":p/ssn", "?any"]]) == [("a",), ("b",), ("c",)]
    for where, find, code in (
        ([["?e", ":p/ssn", "?x"]], ["?x"], "projection"),
        ([["?e", ":p/ssn", "?x"], ["=", "?x", "123"]], ["?e"], "predicate"),
        ([["?e", ":p/ssn", "?x"], ["?f", ":p/name", "?x"]], ["?e"], "join"),
        ([["?e", "?a", "123"]], ["?e"], "dynamic-attribute"),
        ([["?e", ":p/ssn", "?x"], ["?f", ":p/pin", "?x"]], ["?e"], "join"),
    ):
        with pytest.raises(ValidationError) as e:
            ask(where, find)
        assert e.value.code == code
    assert X.scrub(s.facts(), "a").where("blind IS NOT NULL").count() == 2
    assert s.facts().where("v.txt LIKE '%123%'").count() == 0


def test_live(spark, tmp_path):
    s, got = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000), []
    s.transact([P("a", ":p/name", "Ann", validTo=7000)])
    q = {"find": ["?n"], "where": [["?e", ":p/name", "?n"]]}
    run = lambda: watch(s, q, lambda df, info: got.append((df.count(), info)), f"file://{tmp_path}/c", available_now=True).awaitTermination()
    run()
    s.transact([P("b", ":p/name", "Bob")])
    run()
    assert [(n, i["position"]) for n, i in got] == [(1, 1), (2, 2)] and got[0][1]["boundary"] == 7000
    r = Registry()
    k = r.subscribe("me", q)
    assert r.subscribe("you", q) == k
    assert r.split(s.changes()) == ([k], []) and r.split(s.changes().where("attribute = ':p/other'")) == ([], [k])


def test_outbox_and_compaction(store):
    store.transact([{"op": "append-entry", "scope": "s", "key": "k", "payload": {"a": 1}}, {"op": "append-entry", "scope": "s", "key": "k2"}])
    store.transact([{"op": "acknowledge-entry", "scope": "s", "key": "k"}])
    assert [r["key"] for r in store.pending("s").collect()] == ["k2"]
    before = sorted(map(str, store.facts().collect()))
    store.compact()
    assert sorted(map(str, store.facts().collect())) == before and len(store.manifest()["segments"]) == 1
    assert store.feed(prefix="a").count() == 1 and store.transactions_for_entity("b").count() == 1
    assert [len(r["facts"]) for r in store.entities(["b", "none", "a"]).collect()] == [2, 0, 2]


def test_manifests_are_whole_or_absent(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    s.transact([P("a", ":p/name", "Ann")])
    # What a writer leaves that died: a temporary file, and a segment that no manifest names.
    (tmp_path / "s/manifest/.dead.tmp").write_text("")
    (tmp_path / "s/segments/000000000002-dead").mkdir()
    assert s.head() == 1 and s.facts().count() == 1
    with pytest.raises(CommitError) as e:
        s._publish({"position": 1, "instant": 1, "segments": []})
    assert e.value.code == "stale_head" and s.facts().count() == 1
    old = s.manifest()
    s.compact()
    assert s.head() == 1 and s.manifest()["generation"] == 1 and len(s.manifest()["segments"]) == 1
    assert s.facts(old).count() == 1  # a reader that holds the old manifest still reads
    with pytest.raises(CommitError):
        s._regenerate(old, [])
    s.transact([P("b", ":p/name", "Bob")])
    assert s.head() == 2 and s.facts().count() == 2


def test_load_is_judged(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", RULES, clock=lambda: 1000)
    rows = lambda *facts: spark.createDataFrame([(e, a, "string", v, "person") for e, a, v in facts], "entity string, attribute string, vtype string, v string, entity_type string").withColumn("v", V.struct(F.col("v"), V.TEXT))
    s.load(rows(("a", ":p/name", "Ann"), ("b", ":p/name", "Bob"), ("a", ":p/mail", "x")))
    for bad, code in ((rows(("c", ":p/mail", "z")), "constraint"), (rows(("c", ":p/name", "Cy"), ("c", ":p/mail", "x")), "constraint"), (rows(("c", ":_tx/actor", "z")), "reserved"), (rows(("tx:9", ":p/name", "z")), "reserved")):
        with pytest.raises(CommitError) as e:
            s.load(bad)
        assert e.value.code == code and s.head() == 1
    s.validators = [lambda before, after: "too many" if after.query({"find": ["?e"], "where": [["?e", ":p/name", "?n"]]}).count() > 3 else None]
    s.load(rows(("c", ":p/name", "Cy")))
    with pytest.raises(CommitError):
        s.load(rows(("d", ":p/name", "Di")))


def test_constraints_judge_what_a_commit_touches(store, spark):
    live = store.facts().where("retracted_position IS NULL")
    of = lambda *ids: {r["entity"] for r in C.relevant(live, spark.createDataFrame([(i,) for i in ids], "entity string"), RULES).collect()}
    assert of("a") == {"a", "b"} and of("b") == {"a", "b"} and of("none") == {"none"}
    with pytest.raises(CommitError) as e:  # the target goes, its referrer is not touched
        store.transact([{"op": "retract-pattern", "pattern": {"entity": "a"}}])
    assert {v["kind"] for v in e.value.more["violations"]} == {"ReferenceTarget"}


def test_consumers_advance_once(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    for k in range(3):
        s.transact([P("a", ":p/note", str(k))])
    assert s.consumer("mail / odd ☂") == 0 and s.advance("mail / odd ☂", 0, 2) == 2
    assert s.advance("mail / odd ☂", 0, 2) == 2  # again
    for expected, to, code in ((0, 1, "checkpoint_conflict"), (2, 9, "invalid_checkpoint"), (2, 1, "invalid_checkpoint")):
        with pytest.raises(CommitError) as e:
            s.advance("mail / odd ☂", expected, to)
        assert e.value.code == code
    assert s.advance("mail / odd ☂", 2, 3) == 3 and s.consumer("other") == 0


def test_why_tells_when_the_chain_goes_on(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    for k in range(5):
        r = s.transact([P("a", ":p/note", str(k))], actor=f"u{k}", command_id=f"c{k}", causation_id=f"c{k - 1}" if k else None)
    got = D.why(s, r.ids[0]).orderBy("step").collect()
    assert [x["actor"] for x in got] == ["u4", "u3", "u2", "u1", "u0"] and not any(x["more"] for x in got)
    cut = D.why(s, r.ids[0], depth=3).orderBy("step").collect()
    assert [x["more"] for x in cut] == [False, False, True]
    assert D.why_attribute(s, "a", ":p/note").count() == 5 and {x["actor"] for x in D.why_entity(s, "a").collect()} == {f"u{k}" for k in range(5)}


def test_preview(store):
    d = D.Derivation.make("boss", {"find": ["?e", "?n"], "where": [["?e", ":p/boss", "?b"], ["?b", ":p/name", "?n"]]}, ["?e"], ["?n"])
    name = store.facts().where("entity = 'a' AND attribute = ':p/name'").first()["id"]
    n = store.head()
    got = D.preview(store, [{"op": "retract", "id": name}, P("a", ":p/name", "Eva", validFrom=0)], [d], valid_at=10)
    assert [r["change"] for r in got["derivations"]["boss"].collect()] == ["changed"]
    assert got["changes"].count() == 2 and got["violations"].count() == 0 and store.head() == n


def test_runner_delivers_at_least_once(spark, tmp_path):
    now, got, fail = [1000], [], [2]
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: now[0])
    s.transact([P("a", ":p/name", "Ann", validTo=9000)])
    d = D.Derivation.make("n", {"find": ["?e"], "where": [["?e", ":p/name", "?n"]]}, ["?e"])

    def deliver(info, diff):
        if fail[0]:
            fail[0] -= 1
            got.append((info["batch_id"], "failed"))
            raise OSError("down")
        got.append((info["batch_id"], info["reason"], info["attempt"], sorted(r["change"] for r in diff.collect())))

    make = lambda: (r := R.Runner(s, "mailer", max_attempts=2, first_delay=100), r.register("names", d, deliver))[0]
    r = make()
    assert r.tick() == [] and r.tick() == []  # not before the delay is over
    now[0] += 100
    assert r.tick() == [] and r.status()["names"]["pending"]["paused"]
    now[0] += 100_000 - now[0] + 2000  # back at 2000 after the pause has been seen
    now[0] = 2000
    assert r.tick() == []
    r.retry_paused("names")
    r = make()  # another process goes on where this one ended
    assert r.tick() == ["names"] and got[-1][1:] == ("initial", 1, ["added"]) and len({b for b, *_ in got}) == 1
    assert r.tick() == []
    s.transact([P("a", ":p/other", "x")])
    assert r.tick() == []
    s.transact([P("b", ":p/name", "Bob")])
    assert r.tick() == ["names"] and got[-1][1] == "commit"
    now[0] = 9500
    assert r.tick() == ["names"] and got[-1][1::2] == ("time", ["removed"]) and r.status()["names"]["lag"] == 0
    with pytest.raises(R.RunnerError):
        r.register("names", d, deliver)


def test_config_nodes_and_releases(spark, tmp_path):
    field = lambda k, t: G.Node("field", k, {"type": t})
    form = lambda *fields, refs=(): G.Node("form", "visit", {"title": "Visit"}, tuple(("has", f) for f in fields), refs)
    one, two = form(field("age", "integer"), field("name", "text")), form(field("name", "text"), field("age", "number"), field("mail", "text"))
    assert form(field("age", "integer"), field("name", "text")).id == one.id != two.id
    assert [(c["change"], c["path"]) for c in G.diff(one, two)] == [("changed", "visit"), ("changed", "visit/has:age"), ("added", "visit/has:mail")]
    assert G.diff(one, two)[0]["reordered"] and not G.diff(one, two)[0]["attrs"] and G.diff(one, one) == []
    assert [c["change"] for c in G.diff(two, one)][-1] == "removed"
    policy = lambda n: G.Node("policy", "adult", {"min": n})
    assert G.closure_id(one, [policy(18)]) != G.closure_id(one, [policy(21)]) == G.closure_id(one, [policy(21), policy(21)])
    with pytest.raises(ValidationError):
        G.closure_id(one, [policy(18), policy(21)])
    with pytest.raises(ValidationError):
        form(field("age", "integer"), field("age", "text"))
    c = G.ConfigStore(Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000))
    step = G.Node("step", "check", {}, refs=(("uses", "form", "visit"),))
    a = c.commit("first", [form(field("age", "integer"), refs=(("by", "policy", "adult"),)), policy(18), step], ref="live")
    b = c.commit("second", [two, policy(21)])
    n = c.store.head()
    assert c.commit("second", [two, policy(21)]) == b and c.store.head() == n  # nothing new
    assert c.resolve_ref("live") == a and c.resolve_ref("none") is None
    c.set_ref("live", b)
    assert c.resolve_ref("live") == b and c.revisions(a).count() == 3
    assert sorted(r["key"] for r in c.reverse_dependencies("policy", "adult").collect()) == ["check", "visit"]  # the step through the form
    assert c.recheck(a, "policy", T.Record((("min", T.Bounded(T.Prim("integer"), min=20), True),))) == ["adult"] and c.recheck(b, "policy", T.Record((("min", T.Bounded(T.Prim("integer"), min=20), True),))) == []
    with pytest.raises(ValidationError):
        c.set_ref("live", "nothing")


def test_answers_rest_on_what_they_read(store, spark):
    live = store.facts().where("retracted_position IS NULL")
    subjects = live.select("entity").distinct()
    rules = {"boss": ("exists", ":p/boss"), "x": ("eq", ":p/mail", "x"), "either": ("any", [("rule", "boss"), ("rule", "x")]), "early": ("before", ":p/born", "day")}
    one = K.answers(live, subjects, rules, 0)
    kept = spark.createDataFrame(one.collect(), one.schema)
    assert {(r["entity"], r["rule"]): r["truth"] for r in kept.collect()}["b", "either"] is True
    again = K.answers(live, subjects, rules, 5, kept)
    assert again.where("NOT hit").count() == 0  # the same day
    assert {r["rule"] for r in K.answers(live, subjects, rules, K.DAY, kept).where("NOT hit").collect()} == {"early"}
    other = live.where("attribute <> ':p/boss'")
    got = {(r["entity"], r["rule"]): r["verdict"] for r in K.replay(kept, other, rules, 0).collect()}
    assert got["b", "boss"] == got["b", "either"] == "moved" and got["a", "x"] == "same"
    assert {r["verdict"] for r in K.replay(kept.withColumn("truth", F.lit(True)), live, rules, 0).collect()} == {"same", "wrong"}


def test_normalize():
    t = T.Record((("n", T.Prim("integer"), True), ("tags", T.ListOf(T.Prim("text")), False, []), ("of", T.Union((T.Prim("number"), T.Prim("text"))), False)))
    assert T.normalize(t, {"n": 3.0, "more": 1}) == {"n": 3, "tags": []} == T.normalize(t, {"n": 3, "tags": []})
    for bad in ({}, {"n": 1.5}, {"n": 1, "of": True}):
        with pytest.raises(ValueError):
            T.normalize(t, bad)
    assert T.relation(T.Prim("date"), T.Prim("text")) == T.relation(T.Prim("instant"), T.Prim("number")) == "incompatible"


def test_validation_runs(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    t = T.EntityType("person", (T.Attribute(":p/name", T.Prim("text"), True),))
    runs = T.ValidationRuns(s, t, f"file://{tmp_path}/v")
    ids = lambda df: sorted(r["entity"] for r in df.collect())
    assert ids(runs.ever_invalid()) == ids(runs.current_invalid()) == []
    r = s.transact([P("a", ":p/name", "Ann"), P("b", ":p/name", 7)])
    assert runs.run() == 1 and ids(runs.current_invalid()) == ["b"]
    s.transact([{"op": "retract", "id": r.ids[1]}, P("b", ":p/name", "Bob")])
    assert ids(runs.current_invalid()) == [] and ids(runs.last_invalid()) == ["b"]
    assert runs.run() == 2 and ids(runs.last_invalid()) == [] and ids(runs.ever_invalid()) == ["b"]
    assert [(x["run"], x["problem"]) for x in runs.violations("b").collect()] == [(1, "invalid")]


def test_snapshots_of_a_store(spark, tmp_path):
    now = [1000]
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: now[0])
    r = s.transact([P("a", ":p/name", "Ann"), P("b", ":p/name", "Bob")])
    now[0] = 2000
    s.transact([{"op": "retract", "id": r.ids[0]}, P("a", ":p/name", "Eva")])
    s.transact([P("a", ":p/name", "Ann"), {"op": "retract-pattern", "pattern": {"entity": "a", "value": "Eva"}}])
    s.transact([{"op": "retract-pattern", "pattern": {"entity": "a"}}])
    h = [x["hash"] for x in N.hashes(s, "a").orderBy("position").collect()]
    assert h[0] == h[2] != h[1] and h[3] is None
    assert [x["hash"] for x in N.at(s, ["a"], position=2).collect()] == [h[1]] and N.at(s, ["a"]).count() == 0 and N.at(s).count() == 1
    assert N.checkpoint(s, 1500).count() == 2 and {x["entity"] for x in N.find_changed(s, 0).collect()} == {"b"}


def test_sealed_maintenance(spark, tmp_path):
    old = X.Codec("k1", lambda t: t[::-1], lambda t: t[::-1], b"one")
    new = X.Codec("k2", lambda t: t.swapcase()[::-1], lambda t: t[::-1].swapcase(), b"one")
    z = X.Sealing(old, {":p/ssn": "string"})
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)
    s.transact([P(e, ":p/ssn", z.value(":p/ssn", v)) for e, v in (("a", "Ab1"), ("b", "Ab1"), ("c", "Cd2"))])
    ask = lambda codec: sorted(r["e"] for r in s.base(sealing=X.Sealing(codec, z.attributes)).query({"find": ["?e"], "where": [["?e", ":p/ssn", "Ab1"]]}).collect())
    plain = lambda *codecs: sorted((r["entity"], r["plain"]) for r in X.opened(s.sealed_facts(), *codecs).collect())
    want = [("a", '"Ab1"'), ("b", '"Ab1"'), ("c", '"Cd2"')]
    assert plain(old) == want and ask(old) == ["a", "b"]
    assert X.rewrap(s, old, new) == 3 and X.rewrap(s, old, new) == 0
    assert plain(new) == want and plain(old) == [(e, None) for e, _ in want] and ask(new) == ["a", "b"]
    late = X.rotate_blind_key(s, new, b"two")
    assert ask(late) == ["a", "b"] and ask(new) == [] and plain(late) == want
    assert s.head() == 1  # none of this is journaled
    assert X.erase(s, "b", actor="dpo") == 1 and s.head() == 2
    assert ask(late) == ["a"] and plain(late) == [("a", '"Ab1"'), ("b", None), ("c", '"Cd2"')]
    assert s.scrub_blind_tokens() == 2 and ask(late) == [] and s.base().query({"find": ["?e"], "where": [["?e", ":p/ssn", "?x"]]}).count() == 3


def test_watch_wakes_in_time(spark, tmp_path):
    now, got, idle = [1000], [], []
    s = Store(spark, f"file://{tmp_path}/s", clock=lambda: now[0])
    s.transact([P("a", ":p/name", "Ann", validTo=7000), P("b", ":p/name", "Bob", validFrom=5000)])
    q = {"find": ["?n"], "where": [["?e", ":p/name", "?n"]]}
    w = Watch(s, q, lambda df, info: got.append((sorted(r["n"]["txt"] for r in df.collect()), info["reason"])), idle=lambda: idle.append(1))
    assert w.poll() == "initial" and w.poll() is None and len(idle) == 1 and w.token["boundary"] == 5000
    now[0] = 5000
    assert w.poll() == "time" and w.token["boundary"] == 7000
    now[0] = 7000
    assert w.poll() == "time" and w.token["boundary"] is None
    now[0] = 6000
    assert w.poll() == "time"  # the clock ran backwards
    s.transact([P("c", ":p/other", "x")])
    assert w.poll() is None
    s.transact([P("c", ":p/other", "y")])
    s.transact([P("c", ":p/name", "Cy")])
    assert w.poll() == "coalesced"  # another commit came before
    s.transact([P("d", ":p/name", "Di")])
    assert w.poll() == "commit"
    assert got == [(["Ann"], "initial"), (["Ann", "Bob"], "time"), (["Bob"], "time"), (["Ann", "Bob"], "time"), (["Ann", "Bob", "Cy"], "coalesced"), (["Ann", "Bob", "Cy", "Di"], "commit")]
    again = Watch(s, q, lambda df, info: got.append(info["reason"]), token=w.token)
    assert again.poll() == "resume" and again.poll() is None and got[-1] == "resume"
    with pytest.raises(ValueError, match="more than 2"):
        Watch(s, q, lambda df, info: None, max_rows=2).poll()
    beats = Watch(s, q, lambda df, info: got.append("beat")).start(f"file://{tmp_path}/c", "200 milliseconds")
    for _ in range(100):
        if got[-1] == "beat":
            break
        time.sleep(0.2)
    beats.stop()
    assert got[-1] == "beat"


def test_reactor_answers_for_what_was_touched(store):
    live = store.facts().where("retracted_position IS NULL")
    after = live.where("NOT (entity = 'a' AND attribute = ':p/mail')")
    changes = live.where("attribute = ':p/mail'").select("entity", "attribute")
    r = Reactor({"x": ("eq", ":p/mail", "x"), "mailless": ("not", ("exists", ":p/mail")), "boss": ("exists", ":p/boss")})
    assert {(x["entity"], x["rule"], x["before"], x["after"]) for x in r.react(changes, live, after, 0).collect()} == {("a", "x", True, None), ("a", "mailless", False, True)}
    assert r.react(changes.withColumn("attribute", F.lit(":p/none")), live, after, 0).count() == 0
