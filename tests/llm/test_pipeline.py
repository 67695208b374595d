import os

import pytest

import corpus_pipeline
from fundflow.llm import queries as text_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_hand_on_documents(spark):
    """Each stage against what the plain versions of its operator keep."""
    from test_dedup import components, shingle_sets
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    start, kept, lines, single, clean = seen
    assert set(kept) < set(start) and all(kept[i] == start[i] for i in kept) and set(lines) == set(kept)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    docs_of = {}
    for i, t in kept.items():
        for x in {key(x) for x in (t or "").split("\n")} - {""}:
            docs_of.setdefault(x, set()).add(i)
    assert all(lines[i] == "\n".join(x for x in kept[i].split("\n") if len(docs_of.get(key(x), ())) < 10) for i in kept)
    order = sorted(lines)
    groups = components(shingle_sets([lines[i] for i in order]))
    assert set(single) == {order[g] for g in groups}
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, t in single.items() if any(f" {' '.join(b)} " in f" {' '.join(t.lower().split())} " for b in bench)}
    assert not holds & set(clean) and set(single) - set(clean) >= holds
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert last == {i: t.encode(x, add_special_tokens=False).ids for i, x in clean.items()}


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in text_queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "bpe_codec"]
