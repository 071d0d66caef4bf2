"""The pipeline as a whole against its stages done one document at a time."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gatewright.llm.pii import find_pii
from gatewright.llm.quality import fit_quality, score_quality
from gatewright.llm.queries import QUALITY_BOUND

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingled(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_the_pipeline_equals_its_stages_one_document_at_a_time(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in score_quality(docs, model).where(f"score >= {QUALITY_BOUND}").select("row.*").collect()}
    good = len(texts)

    groups = defaultdict(list)
    for d, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(d)
    texts = {d: texts[d] for own in groups.values() for d in [min(own, key=lambda d: (-len(texts[d]), d))]}
    once = len(texts)

    ids, sets = sorted(texts), {d: shingled(t) for d, t in texts.items()}
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if root[a] != root[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    texts = {d: texts[d] for d in set(root.values())}
    assert docs.count() > good > once > len(texts) > 100

    clean = {r.doc_id: r.clean for r in find_pii(docs.where(docs.doc_id.isin([*texts]))).select("row.doc_id", "clean").collect()}
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tokens.encode(t, add_special_tokens=False).ids, 0] for d, t in clean.items()}

    got, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append((r.start, list(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got.keys() == want.keys()
    for d, pieces in got.items():
        pieces.sort()
        assert [i for _, ids_, _ in pieces for i in ids_] == want[d] and {n for *_, n in pieces} == {len(want[d])}
        assert [s for s, *_ in pieces] == np.cumsum([0, *(len(i) for _, i, _ in pieces)])[:-1].tolist()
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 1024
