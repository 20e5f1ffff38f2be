from __future__ import annotations

import os
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
from test_bpe import expected
from test_lines import plain as removed_lines
from test_mixing import plain_targets
from test_quality import plain as measures
from test_simhash import plain_components, plain_fingerprint

from seriesloom.llm import quality

SMALL = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_match_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = (before.collect(), docs.collect())
        if name != "encode":
            assert docs.columns == columns

    before, after = steps["quality_rules"]
    kept = {r.doc_id: r for r in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for r in before:
        if measures(r.text)[-1]:
            assert r.doc_id not in kept
        elif labels.get(r.doc_id) == 1:
            # A clean document may hold a line of a page's furniture; nothing else goes.
            assert kept[r.doc_id].text == "\n".join(x for x in r.text.split("\n") if x != "All rights reserved.")
    assert not any(labels.get(i) == 0 for i in kept)

    before, after = steps["line_dedup"]
    left = {r.doc_id: r for r in after}
    assert len(left) == len(before) == len(after)
    for r, gone in zip(before, removed_lines([(r.doc_id, r.text) for r in before]), strict=True):
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone)
        assert left[r.doc_id].text == text
        assert left[r.doc_id].n_chars == (len(text) if gone else r.n_chars)

    before, after = steps["near_duplicates"]
    names = plain_components([plain_fingerprint(r.text) for r in before], 4)
    first: dict = {}
    for r, name in sorted(zip(before, names, strict=True)):
        first.setdefault(name, r)
    assert sorted(after) == sorted(first.values())

    before, after = steps["mix_sources"]
    sizes: dict = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    taken = dict.fromkeys(sizes, 0)
    for r in after:
        taken[r.source] += len(r.text.encode().split())
    longest = max(len(r.text.encode().split()) for r in before)
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= longest
    assert all(after.count(r) <= 2 for r in before) and set(after) <= set(before)

    before, after = steps["encode"]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted(map(tuple, after)) == sorted((r.doc_id, *expected(path, r.text)) for r in before)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    os.symlink(f"{REPO}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.makedirs(tmp_path / "seriesloom")
    for name in os.listdir(f"{REPO}/seriesloom"):
        if name != "llm":
            os.symlink(f"{REPO}/seriesloom/{name}", tmp_path / "seriesloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_cleaned_lines_are_those_that_pass(spark):
    text = "A clean sentence ends here.\nHome | News | Sport | Contact\nAll rights reserved.\nx### y$$$ z%%%\nAnother sentence."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.assess(docs).first().cleaned == "A clean sentence ends here.\nAnother sentence."
