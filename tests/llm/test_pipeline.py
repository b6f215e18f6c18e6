"""The pipeline stage by stage against brute force, on awkward rows, more columns than it knows, and none."""

import collections
import hashlib

import corpus_pipeline
import public_tokenizers as P
from roadweave.llm import mixing, suffix_dedup
from tests.llm import corpus as C


def test_stages(spark, tmp_path):
    data = C.rows(seed=9, n=90)
    docs = C.clashing(C.frame(spark, data))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        text = {r.doc_id: r.text for r in before}
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        fed, at = at, spark.read.parquet(f"{tmp_path}/{k}")
        rows = at.collect()
        if k < 4:
            assert at.columns == docs.columns and all(r[c] == n for r in rows for n, c in enumerate(C.CLASHES))
        if name == "quality rules":
            assert all(not C.rules(r.text)[5] for r in rows)
        if name == "near duplicates":
            got = C.components([(r.doc_id, r.text) for r in before], 5, 80)
            assert C.content(rows) == C.content(r for r in before if r.doc_id == got[r.doc_id][1])
        if name == "repeated strings":
            want = {i: n - gone for i, n, gone, *_ in C.repeats([(r.doc_id, r.text) for r in before], 200)}
            for r in rows:
                assert want[r.doc_id] - 6 <= len(r.text.encode()) <= want[r.doc_id]
        if name == "mix":
            plan = collections.Counter(r.doc_id for r in mixing.plan(fed, whole=True).collect() for _ in r.pieces)
            assert collections.Counter(r.doc_id for r in rows) == plan and all(r.text == text[r.doc_id] for r in rows)
        if name == "token ids":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
            ids = {i: " ".join(map(str, [*sp.encode(t), 2])) for i, t in text.items()}
            assert len(rows) == len(before) and all(r.ids_sha256 == hashlib.sha256(ids[r.doc_id].encode()).hexdigest() for r in rows)
    assert at.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_repeated_strings_moves_a_text_once(spark, monkeypatch):
    """What the stage makes anew does not travel a second time beside the text, and the other columns come back as they were."""
    seen = []
    real = suffix_dedup.remove_repeats
    monkeypatch.setattr(suffix_dedup, "remove_repeats", lambda docs, **k: seen.append(real(docs, **k)) or seen[-1])
    docs = C.clashing(C.frame(spark, C.rows(seed=9, n=30)))
    out = corpus_pipeline.repeated_strings(spark, docs, "")
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert set(seen[0].schema["carried"].dataType.names) == set(docs.columns) - {"text", "n_chars"}
    was = {r.doc_id: r for r in docs.collect()}
    for r in out.collect():
        assert r.n_chars == len(r.text) and all(r[c] == was[r.doc_id][c] for c in docs.columns if c not in ("text", "n_chars"))


def test_run_on_nothing(spark, tmp_path):
    C.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_nulls(spark, tmp_path):
    """Nulls in every column, texts without a word, repeated rows: only whole documents get through."""
    good = " ".join(f"word{i}" for i in range(60))
    data = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0), (3, good, None, None, None), (3, good, None, None, None), (None, " ".join(f"term{i}" for i in range(50)), "en", None, 9)]
    C.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens > 1 for r in out) and {r.doc_id for r in out} <= {3, None}
