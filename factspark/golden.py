"""Scripted cases in the public JSON vocabulary of steps, and two applications told as worlds: a lending library and deployments.

Each query gives one row an assertion, its value as JSON with sorted keys; the SQL states the frozen values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from factspark.catalogue import register
from factspark.errors import ConstraintViolation
from factspark.plans.patterns import metrics
from factspark.sources.commits import MemoryStore
from factspark.terms import Entity, Fact, Literal, Pattern, Predicate, Symbol, Variable
from factspark.transactions import Transaction
from factspark.world import World


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Case:
    """Runs the steps of one case: ``define forget display_name bind_symbol compile`` change it, the others are assertions."""

    def __init__(self, spark: SparkSession, case: dict):
        self.store, self.steps, self.compiled, self.staged = MemoryStore(spark), case["steps"], {}, []
        with Transaction(self.store) as tx:
            self.ids = {name: tx.entity() for name in case["entities"]}
        self.names = {e: n for n, e in self.ids.items()}

    def term(self, x):
        kinds = {"entity": lambda v: self.ids[v], "literal": Literal, "variable": Variable, "symbol": Symbol}
        ((kind, value),) = x.items()
        return kinds[kind](value)

    def told(self, atom) -> dict:
        return {"entity": self.names[atom]} if isinstance(atom, Entity) else {"literal": str(atom)}

    def fact(self, f: Fact | None) -> dict | None:
        return f and {"subject": self.told(f.s), "predicate": f.p.name, "object": self.told(f.o)}

    def pattern(self, x: dict) -> Pattern:
        return self.compiled[x["compiled"]] if "compiled" in x else Pattern(self.term(x["subject"]), Predicate(x["predicate"]), self.term(x["object"]))

    def world(self) -> World:
        """The world after all steps so far, in one more commit if there were changes."""
        if self.staged:
            with Transaction(self.store) as tx:
                for change in self.staged:
                    change(tx)
            self.staged = []
        return self.store.world()

    def change(self, step: dict) -> bool:
        match step["op"]:
            case "define":
                f = step["fact"]
                fact = Fact(self.term(f["subject"]), Predicate(f["predicate"]), self.term(f["object"]))
                self.staged.append(lambda tx: tx.define(step["slot"], fact))
            case "forget":
                self.staged.append(lambda tx: tx.forget(step["slot"]))
            case "display_name":
                self.staged.append(lambda tx: tx.define_display_name(self.ids[step["entity"]], step["value"]))
            case "bind_symbol":
                self.staged.append(lambda tx: tx.bind_symbol(step["namespace"], step["symbol"], self.ids[step["entity"]]))
            case "compile":
                self.compiled[step["as"]] = self.world().compile(step["namespace"], self.term(step["subject"]), step["predicate"], self.term(step["object"]))
            case _:
                return False
        return True

    def assertion(self, step: dict):
        world = self.world()
        match step["op"]:
            case "resolve":
                return self.fact(world.resolve(step["slot"]))
            case "definitions":
                return [self.fact(f) for f in world.definitions(step["slot"])]
            case "history_kinds":
                return [r["kind"] for r in world.history(step["slot"]).collect()]
            case "display_name_value":
                return world.display_name(self.ids[step["entity"]])
            case "query":
                patterns = [self.pattern(p) for p in step["patterns"]]
                rows = world.bindings(patterns, distinct=step.get("distinct", True), provenance=step.get("include_provenance", False), optimize=step.get("optimize", True))
                out = {"rows": [{"binding": {k: self.told(v) for k, v in r.items() if k != "provenance"}} | ({"provenance": r["provenance"]} if "provenance" in r else {}) for r in rows]}
                if step.get("metrics"):
                    totals = {"candidate_facts": "candidates", "bindings_emitted": "emitted"}
                    counted = metrics(world.active, patterns).collect()
                    out["metrics"] = {m: sum(r[totals[m]] for r in counted) for m in step["metrics"]}
                return out
        raise ValueError(f"there is no step {step['op']!r}")

    def run(self) -> Iterator[tuple[str, str]]:
        """(name, value) of each assertion in order; the world is audited at the end."""
        for step in self.steps:
            if not self.change(step):
                yield step["name"], canonical(self.assertion(step))
        if self.world().audit().count():
            raise AssertionError("the heads aren't those that the records left")


def run_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """(case, name, value) of every assertion of cases as read from JSON."""
    rows = [(c["name"], name, value) for c in cases for name, value in Case(spark, c).run()]
    return spark.createDataFrame(rows, "case string, name string, value string")


def _e(x):
    return {"entity": x}


def _v(x):
    return {"variable": x}


def _l(x):
    return {"literal": x}


def _claim(s, p, o) -> dict:
    return {"subject": s, "predicate": p, "object": o}


def _define(slot, *claim) -> dict:
    return {"op": "define", "slot": slot, "fact": _claim(*claim)}


def _query(name, *patterns, **more) -> dict:
    return {"op": "query", "name": name, "patterns": list(patterns), **more}


# The four public cases, step by step, and their frozen results below.
_LOCATION, _WORK, _COPY = "copy/1/location", _e("work"), _e("copy_1")
CASES = [
    {"name": "current-head-history-and-join", "entities": ["work", "copy_1", "copy_2", "shelf_a", "shelf_b"], "steps": [
        _define("work/copy/1", _WORK, "has_copy", _COPY),
        _define("work/copy/2", _WORK, "has_copy", _e("copy_2")),
        _define(_LOCATION, _COPY, "located_at", _e("shelf_a")),
        _define("copy/2/location", _e("copy_2"), "located_at", _e("shelf_b")),
        _query("two-hop join", _claim(_WORK, "has_copy", _v("copy")), _claim(_v("copy"), "located_at", _v("shelf"))),
        _define(_LOCATION, _COPY, "located_at", _e("shelf_b")),
        {"op": "resolve", "name": "redefinition becomes current", "slot": _LOCATION},
        {"op": "definitions", "name": "definition chain is newest first", "slot": _LOCATION},
        {"op": "forget", "slot": _LOCATION},
        {"op": "resolve", "name": "forget reveals prior definition", "slot": _LOCATION},
        {"op": "history_kinds", "name": "history records every operation", "slot": _LOCATION},
    ]},
    {"name": "compiled-symbol-identity", "entities": ["john", "bob", "other"], "steps": [
        *({"op": "display_name", "entity": e, "value": v} for e, v in (("john", "John"), ("bob", "Bob"), ("other", "Other Bob"))),
        *({"op": "bind_symbol", "namespace": "global", "symbol": s, "entity": e} for s, e in (("John", "john"), ("Bob", "bob"))),
        _define("relationship/john-bob", _e("john"), "friend", _e("bob")),
        {"op": "compile", "as": "old", "namespace": "global", **_claim({"symbol": "John"}, "friend", {"symbol": "Bob"})},
        {"op": "display_name", "entity": "bob", "value": "Robert"},
        {"op": "bind_symbol", "namespace": "global", "symbol": "Bob", "entity": "other"},
        _query("old compiled pattern keeps stable identity", {"compiled": "old"}),
        {"op": "compile", "as": "new", "namespace": "global", **_claim({"symbol": "John"}, "friend", {"symbol": "Bob"})},
        _query("new compilation sees symbol rebinding", {"compiled": "new"}),
        {"op": "display_name_value", "name": "display name is independent of identity", "entity": "bob"},
    ]},
    {"name": "duplicate-provenance", "entities": ["work", "copy"], "steps": [
        *(_define(f"assertion/{k}", _WORK, "has_copy", _e("copy")) for k in "ab"),
        _query("distinct bindings collapse duplicate assertions", _claim(_WORK, "has_copy", _v("copy"))),
        _query("provenance preserves duplicate assertions", _claim(_WORK, "has_copy", _v("copy")), distinct=False, include_provenance=True),
    ]},
    {"name": "literal-current-index", "entities": [], "steps": [
        *(_define("deep/state", _l("deep"), "state", _l(f"v{k}")) for k in range(3)),
        _query("query examines only the active head", _claim(_l("deep"), "state", _v("value")), metrics=["candidate_facts"]),
        {"op": "definitions", "name": "history remains reachable", "slot": "deep/state"},
    ]},
]


def _at(shelf: str) -> dict:
    return _claim(_COPY, "located_at", _e(shelf))


def _row(*provenance, **binding) -> dict:
    return {"binding": binding} | ({"provenance": list(provenance)} if provenance else {})


FROZEN = {
    "two-hop join": {"rows": [_row(copy=_COPY, shelf=_e("shelf_a")), _row(copy=_e("copy_2"), shelf=_e("shelf_b"))]},
    "redefinition becomes current": _at("shelf_b"),
    "definition chain is newest first": [_at("shelf_b"), _at("shelf_a")],
    "forget reveals prior definition": _at("shelf_a"),
    "history records every operation": ["define", "define", "forget"],
    "old compiled pattern keeps stable identity": {"rows": [_row()]},
    "new compilation sees symbol rebinding": {"rows": []},
    "display name is independent of identity": "Robert",
    "distinct bindings collapse duplicate assertions": {"rows": [_row(copy=_e("copy"))]},
    "provenance preserves duplicate assertions": {"rows": [_row("assertion/a", copy=_e("copy")), _row("assertion/b", copy=_e("copy"))]},
    "query examines only the active head": {"rows": [_row(value=_l("v2"))], "metrics": {"candidate_facts": 1}},
    "history remains reachable": [_claim(_l("deep"), "state", _l(f"v{k}")) for k in (2, 1, 0)],
}


def values(rows: list[tuple], *names: str) -> str:
    """The SQL of fixed rows of text."""
    told = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"select * from (values {told}) t({', '.join(names)})"


@register("conformance_kernel", values([(c["name"], s["name"], canonical(FROZEN[s["name"]])) for c in CASES for s in c["steps"] if "name" in s], '"case"', "name", "value"))
def conformance_kernel(spark, d):
    return run_cases(spark, json.loads(json.dumps(CASES)))


class Told:
    """A store, entities by display name, and questions whose answers are rows of names."""

    def __init__(self, spark: SparkSession, *names: str):
        self.store = MemoryStore(spark)
        with Transaction(self.store) as tx:
            self.ids = {n: tx.entity() for n in names}
            for n, e in self.ids.items():
                tx.define_display_name(e, n)

    def claim(self, tx: Transaction, s: str, p: str, o: str, slot: str | None = None) -> None:
        tx.define(slot or f"{s}/{p}/{o}", Fact(self.ids[s], Predicate(p), self.ids[o]))

    def ask(self, *patterns: Pattern, show: tuple[str, ...] = ()) -> list[dict]:
        world = self.store.world()
        rows = [r.asDict() for r in world.render(world.query(list(patterns))).collect()]
        out = [{k: v for k, v in r.items() if k != "_row" and (not show or k in show)} for r in rows]
        return sorted(out, key=canonical)

    def __getitem__(self, name: str) -> Entity:
        return self.ids[name]


def _pattern(s, p: str, o) -> Pattern:
    return Pattern(Variable(s) if isinstance(s, str) else s, Predicate(p), Variable(o) if isinstance(o, str) else o)


_LIBRARY = {
    "author": [{"author": "Isaac Asimov"}],
    "copies_and_shelves_initial": [{"copy": "Copy 42", "shelf": "Shelf A3"}, {"copy": "Copy 87", "shelf": "Shelf B1"}],
    "alice_holdings": [{"copy": "Copy 42", "work": "Foundation"}],
    "copy_87_after_move": [{"shelf": "Shelf C3"}],
    "old_compiled_after_symbol_rebind": [{"copy": "Copy 42"}],
    "new_compiled_after_symbol_rebind": [],
    "after_return": [],
}


@register("library_golden", values([(k, canonical(v)) for k, v in _LIBRARY.items()], "name", "value"))
def library_golden(spark, d):
    """Works, copies, shelves and loans: joins, a move, a name bound anew under a compiled pattern, and a return."""
    t, out = Told(spark, "Foundation", "Isaac Asimov", "Copy 42", "Copy 87", "Shelf A3", "Shelf B1", "Shelf C3", "Alice", "Alice the Second"), {}
    with Transaction(t.store) as tx:
        t.claim(tx, "Foundation", "written_by", "Isaac Asimov")
        for copy, shelf in (("Copy 42", "Shelf A3"), ("Copy 87", "Shelf B1")):
            t.claim(tx, copy, "copy_of", "Foundation")
            t.claim(tx, copy, "shelved_at", shelf, f"{copy}/shelved_at/current")
        tx.bind_symbol("library", "Alice", t["Alice"])
    out["author"] = t.ask(_pattern(t["Foundation"], "written_by", "author"))
    out["copies_and_shelves_initial"] = t.ask(_pattern("copy", "copy_of", t["Foundation"]), _pattern("copy", "shelved_at", "shelf"))
    with Transaction(t.store) as tx:
        t.claim(tx, "Copy 42", "lent_to", "Alice", "Copy 42/lent_to/current")
    out["alice_holdings"] = t.ask(_pattern("copy", "lent_to", t["Alice"]), _pattern("copy", "copy_of", "work"))
    with Transaction(t.store) as tx:
        t.claim(tx, "Copy 87", "shelved_at", "Shelf C3", "Copy 87/shelved_at/current")
    out["copy_87_after_move"] = t.ask(_pattern(t["Copy 87"], "shelved_at", "shelf"))
    old = t.store.world().compile("library", Variable("copy"), "lent_to", Symbol("Alice"))
    with Transaction(t.store) as tx:
        tx.bind_symbol("library", "Alice", t["Alice the Second"])
    out["old_compiled_after_symbol_rebind"] = t.ask(old)
    out["new_compiled_after_symbol_rebind"] = t.ask(t.store.world().compile("library", Variable("copy"), "lent_to", Symbol("Alice")))
    with Transaction(t.store) as tx:
        tx.forget("Copy 42/lent_to/current")
    out["after_return"] = t.ask(old)
    return spark.createDataFrame([(k, canonical(v)) for k, v in out.items()], "name string, value string")


# What is released, and what the two applications must show.
_OLD, _NEW = {"API": "API v2", "Schema": "Schema v4", "Worker": "Worker v6"}, {"API": "API v3", "Schema": "Schema v5", "Worker": "Worker v7"}


def _drift(desired: dict, observed: dict, *services: str) -> list[dict]:
    return [{"service": s, "desired": desired[s], "observed": observed[s]} for s in services]


_DEPLOYMENT = {
    "initial_desired": _OLD,
    "initial_observed": _OLD,
    "incompatible_rejected": True,
    "release_12_desired": _NEW,
    "drift_after_release": _drift(_NEW, _OLD, "API", "Schema", "Worker"),
    "drift_after_worker": _drift(_NEW, _OLD, "API", "Schema"),
    "drift_after_schema": _drift(_NEW, _OLD, "API"),
    "drift_after_convergence": [],
    "rollback_desired": _OLD,
    "rollback_drift": _drift(_OLD, _NEW, "API", "Schema", "Worker"),
    "current_release": "Rollback 13",
    "api_desired_history": ["API v2", "API v3", "API v2"],
}


class Deployments(Told):
    """Releases list a version of each service; a candidate is refused if the release isn't approved or a version's requirement isn't desired."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "production", *_OLD, *_OLD.values(), *_NEW.values(), "Release 11", "Release 12", "Mixed 12", "Rollback 13", "Reviewer")
        with Transaction(self.store) as tx:
            for needs, other in (("API v2", "Schema v4"), ("API v3", "Schema v5"), ("Worker v7", "Schema v5")):
                self.claim(tx, needs, "requires", other)
            for service, version in [*_OLD.items(), *_NEW.items()]:
                self.claim(tx, version, "version_of", service)
        self.store.register_validator(self.sound)

    def sound(self, world: World) -> None:
        release = _pattern(self["production"], "release", "release")
        if world.query([release]).count() > world.query([release, _pattern("release", "approved_by", "who")]).count():
            raise ValueError("the release isn't approved")
        wanted = [_pattern("service", "desired", "version"), _pattern("version", "requires", "other"), _pattern("other", "version_of", "owner"), _pattern("owner", "desired", "now")]
        if world.query(wanted).where("other <> now").count():
            raise ValueError("a requirement isn't met")

    def release(self, name: str, manifest: dict[str, str]) -> None:
        with Transaction(self.store) as tx:
            for service, version in manifest.items():
                self.claim(tx, name, "contains", version)
                self.claim(tx, service, "desired", version, f"{service}/desired")
            self.claim(tx, name, "approved_by", "Reviewer")
            self.claim(tx, "production", "release", name, "production/release")

    def observe(self, manifest: dict[str, str], *services: str) -> None:
        with Transaction(self.store) as tx:
            for s in services or manifest:
                self.claim(tx, s, "observed", manifest[s], f"{s}/observed")

    def state(self, kind: str) -> dict[str, str]:
        return {r["service"]: r["version"] for r in self.ask(_pattern("service", kind, "version"))}

    def drift(self) -> list[dict]:
        rows = self.ask(_pattern("service", "desired", "desired"), _pattern("service", "observed", "observed"))
        return sorted((r for r in rows if r["desired"] != r["observed"]), key=lambda r: r["service"])

    def manifest(self, release: str) -> dict[str, str]:
        return {r["service"]: r["version"] for r in self.ask(_pattern(self[release], "contains", "version"), _pattern("version", "version_of", "service"))}


@register("deployment_golden", values([(k, canonical(v)) for k, v in _DEPLOYMENT.items()], "name", "value"))
def deployment_golden(spark, d):
    """A refused release, one that spreads service by service, and a rollback to an earlier release's list."""
    t, out = Deployments(spark), {}
    t.release("Release 11", _OLD)
    t.observe(_OLD)
    out["initial_desired"], out["initial_observed"] = t.state("desired"), t.state("observed")
    try:
        t.release("Mixed 12", _OLD | {"API": "API v3"})
        out["incompatible_rejected"] = False
    except ConstraintViolation:
        out["incompatible_rejected"] = True
    t.release("Release 12", _NEW)
    out["release_12_desired"], out["drift_after_release"] = t.state("desired"), t.drift()
    for name, service in (("drift_after_worker", "Worker"), ("drift_after_schema", "Schema"), ("drift_after_convergence", "API")):
        t.observe(_NEW, service)
        out[name] = t.drift()
    t.release("Rollback 13", t.manifest("Release 11"))
    out["rollback_desired"], out["rollback_drift"] = t.state("desired"), t.drift()
    world = t.store.world()
    out["current_release"] = world.display_name(world.resolve("production/release").o)
    out["api_desired_history"] = [world.display_name(f.o) for f in world.definitions("API/desired")]
    return spark.createDataFrame([(k, canonical(v)) for k, v in out.items()], "name string, value string")
