"""Objects that wait for their files, over several runs of one query."""

import json
import time

import pytest

from granula.streaming import completeness


@pytest.fixture
def world(spark, tmp_path):
    listing, out = tmp_path / "listing", []
    listing.mkdir()

    def run(*files, wait=3600.0):
        """Write rows (object, entity, version, declared) as one file and take in what is new."""
        if files:
            rows = [{"object_key": o, "entity": e, "path": f"/{o}/{e}", "length": 10 + v, "modified": f"2024-01-0{v} 00:00:00", "declared": list(d)} for o, e, v, d in files]
            (listing / f"{len(list(listing.iterdir()))}.json").write_text("\n".join(map(json.dumps, rows)))
        out.clear()
        completeness.run_available(spark, str(listing), lambda df, n: out.extend(df.collect()), str(tmp_path / "checkpoint"), wait)
        return sorted((r.object_key, r.status, json.loads(r.entities), json.loads(r.missing) if r.missing else None) for r in out), {r.object_key: r.fingerprint for r in out}

    return run


def test_late_repeated_and_changed_files(world):
    both = ("pm", "mito")
    found, marks = world(("a", "pm", 1, both), ("a", "mito", 1, both), ("b", "pm", 1, both), ("c", "pm", 1, ()))
    assert found == [("a", "complete", ["mito", "pm"], None), ("c", "complete", ["pm"], None)]
    first = marks["a"]
    # each call is a new query on the old checkpoint: a repeated row says nothing, the late file completes b
    found, marks = world(("a", "pm", 1, both), ("b", "mito", 2, both))
    assert found == [("b", "complete", ["mito", "pm"], None)]
    # a changed file passes its object on again, under another fingerprint; an older version does not
    found, marks = world(("a", "mito", 3, both))
    assert [f[:2] for f in found] == [("a", "complete")] and marks["a"] != first
    assert world(("a", "mito", 2, both))[0] == []
    # what is not declared comes along
    assert world(("b", "extra", 1, both))[0] == [("b", "complete", ["extra", "mito", "pm"], None)]
    assert world()[0] == []


def test_objects_that_wait_too_long(world):
    assert world(("a", "pm", 1, ("pm", "mito")), wait=0.5)[0] == []
    time.sleep(1.0)
    found, _ = world(("b", "pm", 1, ("pm",)), wait=0.5)
    assert found == [("a", "incomplete", ["pm"], ["mito"]), ("b", "complete", ["pm"], None)]
    assert world(("a", "mito", 1, ("pm", "mito")), wait=0.5)[0] == [("a", "complete", ["mito", "pm"], None)]


def test_fingerprints_do_not_depend_on_order():
    a = {"x": ("/x", 1, 2), "y": ("/y", 3, 4)}
    assert completeness.fingerprint(a) == completeness.fingerprint(dict(reversed(a.items()))) != completeness.fingerprint(a | {"x": ("/x", 2, 2)})
