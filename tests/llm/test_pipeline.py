"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ebbtide.llm import mixing
from ebbtide.llm.queries import table, vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs and outputs of all stages, written and read as in a run."""
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    out, docs = {}, table(spark, FOLDER, "documents")
    root = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out[name] = docs, after
        docs = after
    return out


def test_registered():
    assert "pipeline" in entry.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mix", "token_ids"]


def test_all_but_the_last_keep_the_columns(stages):
    columns = stages["quality"][0].columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "token_ids")


def test_quality_keeps_good_documents(spark):
    """On the folder with 400 labels; the smallest one has ten bad documents to learn from."""
    folder = FOLDER.replace("0.001", "0.01")
    labels = {x["doc_id"]: x["quality"] for x in table(spark, folder, "labels").collect()}
    kept = {x["doc_id"] for x in corpus_pipeline.keep_good(spark, table(spark, folder, "documents"), folder).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in kept) == bool(labels[i]) for i in held]) > 0.9
    assert np.mean([i in kept for i in held if labels[i]]) > 0.9


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_copies(stages):
    before, after = stages["near_copies"]
    sets = {x["doc_id"]: shingles(x["text"]) for x in before.collect()}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert sorted(x["doc_id"] for x in after.collect()) == [i for i in ids if find(i) == i]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [x["text"] for x in table(spark, FOLDER, "benchmark").collect()]
    kept = {x["doc_id"] for x in after.collect()}
    for x in before.collect():
        assert (x["doc_id"] in kept) == (not any(t in x["text"] for t in items)), x["doc_id"]


def test_mix_comes_near_its_targets(stages):
    before, after = stages["mix"]
    size, taken, each = Counter(), Counter(), Counter()
    for x in before.collect():
        size[x["source"]] += len(x["text"].encode().split())
        each[x["doc_id"]] = len(x["text"].encode().split())
    got = Counter()
    for x in after.collect():
        n = len(x["text"].encode().split())
        taken[x["source"]] += n
        got[x["doc_id"]] += n
    goal = dict(zip(sorted(size), mixing.targets([size[s] for s in sorted(size)]), strict=True))
    assert all(abs(taken[s] - t) <= 2 * mixing.BLOCK for s, t in goal.items())
    assert all(got[i] <= 2 * each[i] for i in got)


def test_token_files(stages):
    from tokenizers import Tokenizer

    before, after = stages["token_ids"]
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for x in before.collect():
        ids = [*tok.encode(x["text"], add_special_tokens=False).ids, 0]
        want[x["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in after.collect()) == want
