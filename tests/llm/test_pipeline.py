"""The pipeline's stages, each held against its operator's own verdicts on the stage's input."""

import importlib
import os

import numpy as np
import public_tokenizers as P

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    import corpus_pipeline as C
    from colloquy.llm import passages, quality_model, quality_rules, simhash
    from colloquy.llm.common import stored

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    after = {}
    at = docs
    for name, stage in C.STAGES[:-1]:
        before, at = at, stored(stage(spark, at, DATA), name)
        assert at.columns == columns
        after[name] = (before, {r.doc_id: r for r in at.collect()})

    before, kept = after["quality_classifier"]
    assert set(kept) == {r.doc_id for r in quality_model.score(before, labels).collect() if r.score >= 0.3}
    before, kept = after["quality_rules"]
    assert set(kept) == {r.doc_id for r in quality_rules.judge(before, labels).collect() if r.kept}
    before, kept = after["simhash_near_dedup"]
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    seen, groups = set(), []
    for i in sorted(prints):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                x = prints[todo.pop()]
                near = {j for j in prints if j not in group and (prints[j] ^ x).bit_count() <= 3}
                group |= near
                todo += near
            seen |= group
            groups.append(group)
    assert set(kept) == {min(g) for g in groups}
    before, kept = after["substring_dedup"]
    spans = {}
    for r in passages.repeated_passages(before).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.n_words))
    for r in before.collect():
        want = passages.cut_words(r.text.encode(), spans[r.doc_id]).decode() if r.doc_id in spans else r.text
        assert kept[r.doc_id].text == want and kept[r.doc_id].n_chars == (len(want) if r.doc_id in spans else r.n_chars)

    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    parts = {}
    for r in C.STAGES[-1][1](spark, at, DATA).collect():
        parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert set(parts) == set(kept)
    for i, found in parts.items():
        assert [x for _, ids in sorted(found) for x in ids] == [*tokens.encode(kept[i].text, add_special_tokens=False).ids, 1]


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= names
