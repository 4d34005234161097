"""Sync runs end to end, and answers from their index."""

import pytest

from lodestone.operators.chunk import ChunkSize
from lodestone.operators.validate import Limits
from lodestone.plans import answer, ingest


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "keys.md").write_text("# Keys\n\nYou rotate the production keys every ninety days in the console.\n\n## Limits\n\nEach project has at most five active keys at any time.\n")
    (root / "billing.md").write_text("# Billing\n\nRefunds are paid within five business days after a request.\n")
    return root, ingest.Workspace(spark, str(tmp_path_factory.mktemp("ws")))


SETTINGS = ingest.Settings(size=ChunkSize(40, 0, 4), limits=Limits(500, 4, 0.25))


def test_life_of_an_index(spark, world):
    root, ws = world
    first = ingest.run(ws, str(root), SETTINGS)
    assert (first.added, first.chunks_embedded, first.status, first.epoch) == (2, 3, "complete", 1)
    assert first.records == 3
    again = ingest.run(ws, str(root), SETTINGS)
    assert (again.unchanged, again.chunks_embedded, again.records, again.epoch) == (2, 0, 3, 2)

    text = (root / "keys.md").read_text()
    (root / "keys.md").write_text(text.replace("five active", "six active"))
    (root / "empty.md").write_text("  \n")
    edit = ingest.run(ws, str(root), SETTINGS)
    assert (edit.changed, edit.added, edit.chunks_embedded, edit.chunks_reused, edit.records) == (1, 1, 1, 1, 3)
    assert (edit.quarantined, edit.status) == (1, "partial")
    assert "six active" in " ".join(x.text for x in ws.index.read().collect())
    with pytest.raises(ingest.Quarantined):
        ingest.run(ws, str(root), ingest.Settings(size=SETTINGS.size, limits=SETTINGS.limits, fail_fast=True))

    (root / "empty.md").unlink()
    (root / "billing.md").unlink()
    gone = ingest.run(ws, str(root), SETTINGS)
    assert (gone.deleted, gone.records) == (2, 2)
    assert {x.status for x in ws.documents.read().collect()} == {"indexed", "deleted"}

    other = ingest.Settings(size=SETTINGS.size, limits=SETTINGS.limits, model="lexical/32", dimensions=32)
    assert ingest.plan(ws, str(root), other).changed == 1
    moved = ingest.run(ws, str(root), other)
    assert (moved.changed, moved.chunks_embedded, moved.records) == (1, 2, 2)
    assert ws.describe().embed_model == "lexical/32" and ws.describe().dimensions == 32
    with pytest.raises(ValueError, match="dimensions"):
        ingest.run(ws, str(root), ingest.Settings(model="lexical/32", dimensions=8))
    assert ws.runs.read().count() == 5

    questions = spark.createDataFrame([("a", "How do I rotate keys?"), ("b", "How many active keys?")], "query_id string, query string")
    got = {x.query_id: x for x in answer.answers(ws.index.read(), questions, 1, 200, 32).collect()}
    assert "You rotate" in got["a"].answer and got["a"].answer.endswith("[1]") and got["a"].grounded == 1.0
    assert "six active" in got["b"].context
    none = answer.answers(ws.index.read().limit(0), questions, 1, 200, 32).collect()
    assert {x.answer for x in none} == {"I could not find an answer in the sources."}
