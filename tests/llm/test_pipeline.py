"""The whole pipeline on the smallest tables against a brute-force version of each stage."""

import re
from collections import defaultdict

from test_llm_operators import brute_components

import corpus_pipeline
from barwright.llm import common, packing, quality

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def test_run_matches_brute_force(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    accepted = {r.doc_id for r in quality.classify(docs, labels).where("accepted").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(marks[d] == 1 for d in marks if d in accepted) >= 0.98 * sum(q == 1 for q in marks.values()) and len(accepted) < len(texts)
    first = {}
    for doc in sorted(accepted):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[doc]), doc)
    left = sorted(first.values())
    left = [doc for i, (doc, (_, root)) in enumerate(zip(left, brute_components([texts[d] for d in left], 5, 80, 100), strict=True)) if root == i]
    items = [(min(5, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text or ""))), shingles(r.text)) for r in common.table(spark, SMALL, "benchmark").collect()]
    left = [doc for doc in left if not any(s and len(s & shingles(texts[doc], k)) >= 0.8 * len(s) - 1e-9 for k, s in items)]

    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(left)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    sizes, places = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sizes[doc] == len(tokenizer.encode(texts[doc], add_special_tokens=False).ids) + 1 for doc in left)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE
    assert len(places) <= -(-sum(sizes.values()) // packing.SEQUENCE) + 1
