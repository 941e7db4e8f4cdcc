"""Plugins: what a declaration may say, discovery with isolated failures, opting out."""

import json

import pytest

from tracelake.plans import plugins
from tracelake.plans.plugins import Plugin, Plugins
from tracelake.schema import message_types

GOOD = {"namespace": "lab-1", "version": "1.0", "components": {"extractors": {"active.long": "tracelake.plans.extractors:active"}}, "messages": {"lab1/Volt": "value double"}}


class Entry:
    def __init__(self, name, load):
        self.name, self.load = name, load


def fail(e):
    raise e


@pytest.fixture
def entries(monkeypatch):
    found = []
    monkeypatch.setattr(plugins.metadata, "entry_points", lambda group: found if group == plugins.GROUP else [])
    monkeypatch.delenv(plugins.DISABLE, raising=False)
    return found


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"namespace": "a b"}, "namespace"),
        ({"namespace": ""}, "namespace"),
        ({"version": " "}, "no version"),
        ({"components": {"widgets": {}}}, "kind 'widgets'"),
        ({"components": {"queries": {"a-b": "m:f"}}}, "component 'a-b'"),
        ({"components": {"queries": {"a": "m.f"}}}, "not at module:attribute"),
        ({"colour": 1}, "no colour"),
    ],
)
def test_what_a_plugin_may_say(change, said):
    with pytest.raises(ValueError, match=said):
        Plugin.of(GOOD | change)


def test_needed_fields_and_files(tmp_path):
    with pytest.raises(ValueError, match="needs namespace, version"):
        Plugin.of({})
    (tmp_path / "p.json").write_text(json.dumps(GOOD | {"description": "  spaces go "}))
    read = Plugin.read(str(tmp_path / "p.json"))
    assert read.description == "spaces go" and read.names("extractors") == ["lab-1/active.long"] and read.names("queries") == []


def test_failures_are_isolated(spark, entries):
    entries += [
        Entry("broken", lambda: fail(ImportError("no such module"))),
        Entry("good", lambda: GOOD),
        Entry("made", lambda: lambda: Plugin("made", "2", components={"queries": {"q": "no_such_module:f"}})),
        Entry("twice", lambda: GOOD),
        Entry("wrong", lambda: {"namespace": "w"}),
    ]
    found = Plugins().discover()
    assert set(found.taken) == {"lab-1", "made"} and set(found.failed) == {"broken", "twice", "wrong"}
    assert found.failed["broken"] == "ImportError: no such module" and "are registered" in found.failed["twice"]
    assert found.get("extractors", "lab-1/active.long")(["t"], 5).text == "active(['t'], 5)"
    assert "lab1/Volt" in message_types()
    with pytest.raises(ImportError):
        found.get("queries", "made/q")  # only now, as registering imports nothing
    with pytest.raises(KeyError):
        found.get("queries", "made/none")
    assert {(r.kind, r.namespace, r.name, r.loaded) for r in found.listing(spark).collect()} == {("extractors", "lab-1", "active.long", True), ("queries", "made", "q", False)}
    assert {r.plugin: r.reason is None for r in found.report(spark).collect()} == {"lab-1": True, "made": True, "broken": False, "twice": False, "wrong": False}


def test_a_clash_takes_nothing(entries):
    found = Plugins()
    found.register(Plugin("a", "1", components={"queries": {"x": "m:f"}}))
    with pytest.raises(ValueError, match="queries a/x"):
        found.register(Plugin("a", "2", components={"sources": {"y": "m:g"}, "queries": {"x": "m:h"}}))
    assert found.registries["sources"].paths == {} and found.taken["a"].version == "1"


@pytest.mark.parametrize(("value", "enabled", "taken"), [("1", None, 0), ("yes", None, 0), ("0", None, 1), ("", None, 1), ("1", True, 1), ("0", False, 0)])
def test_opting_out(entries, monkeypatch, value, enabled, taken):
    entries.append(Entry("good", lambda: GOOD))
    monkeypatch.setenv(plugins.DISABLE, value)
    assert len(Plugins().discover(enabled=enabled).taken) == taken
