"""The pipeline against a brute-force version, its queries by name, and the library without this subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

from conftest import ROOT, SMALL
from pyspark.sql import functions as F

from llm.test_operators import check_pack


def test_pipeline(spark):
    import corpus_pipeline as cp

    from marlstone.llm import language, queries, secrets, simhash
    from marlstone.llm.scale import crc32_mod

    docs = queries.read(spark, SMALL)
    model = language.fit_languages(docs, crc32_mod(F.col("doc_id"), 3) != 1)
    lab = {r.doc_id: r for r in language.identify_languages(docs, model, spans=False).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if lab[r.doc_id].lang_pred != "und" and lab[r.doc_id].score >= language.LEAST_SHARE}
    keep = {}
    for i in sorted(texts):
        keep[texts[i]] = i
    texts = {i: t for t, i in keep.items()}
    kept = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in simhash.similar_dedup(kept).collect()}
    texts = {i: secrets.redact(t) for i, t in texts.items() if comp[i] == i}
    check_pack(cp.run(spark, SMALL).collect(), texts.items(), 4096)
    assert [n for n, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "secrets", "packing"] and cp.ORACLE_SQL is None
    step = docs
    for _, stage in cp.STAGES[:-1]:
        step = stage(spark, step, SMALL)
        assert step.columns == docs.columns


def test_names():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()


def test_sql(spark):
    import compare

    from marlstone.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert compare.same(queries.QUERIES[name](spark, SMALL), sql, SMALL) is None


def test_library_without_these_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(Path(tmp_path, "repo"))}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
