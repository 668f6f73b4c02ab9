"""The pipeline against a plain version of its stages."""

import random

import corpus_pipeline
import pytest

from gazetta.llm import packing, quality
from gazetta.llm.queries import QUERIES, tokenizer_path

from .helpers import BLANK, PROSE, documents, measures, spans
from .test_operators import greedy


def accepted(text):
    n, chars, symbols, dup, repeat = measures(text)
    lines = len([x for x in (text or "").split("\n") if BLANK.sub("", x)])
    bad = n < 50 or 100 * repeat > 50 * n or symbols > n or chars > 20 * n or chars < 2 * n or (lines >= 4 and 2 * dup > lines)
    return not bad


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    vocabulary = PROSE.split()
    texts = [" ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.randint(20, 1500))) for _ in range(40)]
    texts += [texts[3], texts[3] + " ", "junk *** $$$ " * 60, None, "", texts[5] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    at = tmp_path_factory.mktemp("sf")
    documents(spark, texts).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(d, t) for d, t in rows if accepted(t)]
    best = {}
    for d, t in want:
        key = BLANK.sub("", t)
        if key not in best or (-len(t), d) < (-len(best[key][1]), best[key][0]):
            best[key] = (d, t)
    want = sorted(best.values())
    want = greedy(want)
    final = []
    for d, t in want:
        out, at = "", 0
        for a, _, b, _ in spans(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        final.append((d, out + t[at:]))
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, folder)
        assert got.columns == docs.columns, name
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(final)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    packed = corpus_pipeline.run(spark, folder).collect()
    tokens = {d: len(packing.encode(tokenizer_path("byte_bpe_50k.json"), t)) + 1 for d, t in final}
    assert {d: sum(r.length for r in packed if r.doc_id == d) for d in tokens} == tokens


def test_every_query_is_registered():
    import __spark_entry__

    assert [n for n in __spark_entry__.queries() if n.startswith("op")] == [*QUERIES]
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5
    assert quality.RULES
