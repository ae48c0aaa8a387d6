"""Each stage of the pipeline against brute force over its own input, with nulls, repeats and an empty table."""

import corpus_pipeline as P
import pytest
from test_decontaminate import brute
from test_operators import deduped, joined, made, tokenizers_

from textloom.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = made(3)
    passages = [t for _, t, _ in rows if t and len(t.split()) > 15][:2]
    rows += [(800, f"Before it {passages[0]} and after.", "en"), (801, passages[1].upper(), None), (802, None, None)]
    spark.createDataFrame([(i, t, x, f"s{n % 3}", len(t or "")) for n, (i, t, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(passages), (9, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, passages


def test_stages(spark, folder):
    d, rows, passages = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = P.quality_classifier(spark, docs, d)
    left = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert set(map(str, left)) <= {str((r.doc_id, r.text, r.source)) for r in docs.collect()} and all(t and t.split() for _, t, _ in left)

    near = P.near_duplicates(spark, docs, d)
    want = [(i, t) for (i, t, _), (_, _, root) in zip(rows, joined(rows), strict=True) if i is None or root == i]
    assert sorted(map(str, ((r.doc_id, r.text) for r in near.collect()))) == sorted(map(str, want))

    cut = P.repeated_passages(spark, docs, d)
    assert sorted(map(str, ((r.doc_id, r.text, r.n_chars) for r in cut.collect()))) == sorted(str((i, t, len(t))) for i, _, _, t in deduped(rows))

    clean = P.decontamination(spark, docs, d)
    want = [i for i, t, _ in rows if not t or not any(brute(t, x) for x in passages)]
    assert len(want) < len(rows) - 2 and sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(map(str, want))
    for df in (kept, near, cut, clean):
        assert df.columns == list(P.COLUMNS)

    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokenizers_.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizers_.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = P.token_ids(spark, docs, d).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids) for r in out))) == sorted(str((i, len(x), x)) for i, t, _ in rows for x in [own.encode_ordinary(t or "")])


def test_empty(spark, folder):
    d = folder[0]
    none = spark.read.parquet(f"{d}/documents.parquet").filter("false")
    for name, stage in P.STAGES:
        assert stage(spark, none, d).count() == 0, name
