"""The stages of the pipeline on one small corpus, each against what its operator's brute force says of its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lodeframe.llm import common
from tests.llm.test_dedup_and_pages import brute_components, brute_removed
from tests.llm.test_text_operators import brute_hits, library_ids


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    make = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    passage, item = make(70), make(30)
    texts = [make(60) for _ in range(80)] + [make(40) + " " + passage for _ in range(4)] + [make(20) + " " + item] + [make(50) + " vile rotten foul" for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int((t or "").endswith("foul"))) for i, t, *_ in docs]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), texts, item


def test_every_stage(spark, folder):
    base, texts, item = folder
    docs = common.table(spark, base, "documents")
    columns, inputs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: x[0]) if "text" in docs.columns else None)
        docs = common.written(stage(spark, docs, base), "test-stage")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    kept = {i for i, _ in inputs[1]}
    good = {i for i, t in enumerate(texts) if not (t or "").endswith("foul")}
    assert kept <= good and len(good - kept) <= 2  # the draw may leave out as many as the weights fall short of 1
    ids, bodies = zip(*inputs[1])
    comps, _ = brute_components(bodies, 5)
    assert [i for i, _ in inputs[2]] == [i for k, i in enumerate(ids) if comps[k] == k]
    raws = [(t or "").encode() for _, t in inputs[2]]
    cut = {i: bytes(np.frombuffer(r, np.uint8)[~g]).decode("utf-8", "ignore") for (i, _), r, g in zip(inputs[2], raws, brute_removed(raws))}
    assert dict(inputs[3]) == cut
    clean = [(i, t) for i, t in inputs[3] if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute_hits(t, [(1, item)]))]
    assert inputs[4] == clean
    assert len(clean) < len(inputs[3])
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == sum(len(library_ids(t)) + 1 for _, t in clean)


def test_run_gives_the_same_rows(spark, folder):
    base, *_ = folder
    got = corpus_pipeline.run(spark, base)
    assert got.count() and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
