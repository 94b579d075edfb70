import hashlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from buildloom.llm import langid, mixing
from buildloom.llm.common import read


def test_stages_do_their_part(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mix", "bpe_codec"]
    docs = read(spark, sf_dir, "documents")
    known = corpus_pipeline.known_language(spark, docs, sf_dir).cache()
    rejected = {r["doc_id"] for r in langid.digest(docs).where("rejected").collect()}
    all_rows = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"] for r in known.collect()} == all_rows.keys() - rejected and known.columns == docs.columns

    distinct = corpus_pipeline.distinct_texts(spark, known, sf_dir).cache()
    first: dict[str, int] = {}
    for i in sorted(all_rows.keys() - rejected):
        first.setdefault(brute.normal(all_rows[i]["text"]), i)
    assert {r["doc_id"] for r in distinct.collect()} == set(first.values())

    one = corpus_pipeline.one_of_near_copies(spark, distinct, sf_dir).cache()
    groups = brute.near_groups({i: all_rows[i]["text"] for i in first.values()}, 5, 80, 100)
    left = {i for i, c in groups.items() if i == c}
    assert {r["doc_id"] for r in one.collect()} == left

    mixed = corpus_pipeline.mixed_sources(spark, one, sf_dir).cache()
    planned = {r["doc_id"]: r["__copies"] for r in mixing.plan(one).collect()}
    counts: dict[int, int] = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: n for i, n in planned.items() if n} and mixed.columns == docs.columns

    out = corpus_pipeline.token_ids(spark, mixed, sf_dir).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(out) == sum(counts.values())
    for r in out:
        text = all_rows[r["doc_id"]]["text"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_mix_keeps_the_columns_of_documents(make):
    """Columns named like the plan's keep their types and values."""
    docs = make([(i, "some words", "en", f"s{i % 3}") for i in range(30)]).withColumn("source_size", F.concat(F.lit("own"), "doc_id")).withColumn("__copies", F.lit("y"))
    mixed = mixing.mix(docs)
    assert [(f.name, f.dataType) for f in mixed.schema] == [(f.name, f.dataType) for f in docs.schema]
    rows = mixed.collect()
    assert rows and all(r["target"] == "x" and r["source_size"] == f"own{r['doc_id']}" and r["__copies"] == "y" for r in rows)


def test_run(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.count() > 0 and df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
