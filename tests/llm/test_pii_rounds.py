"""Instances found in one round are seeds of the next; every base span gives context."""

from barwright.llm import pii


def found(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: [(s.kind, s.text) for s in r.found] for r in pii.find_pii(rows).collect()}


def test_discovered_instances_induce_patterns(spark):
    texts = [f"contact phone: +1 212 555 {i:04d} please" for i in range(60)]
    texts += [f"contact phone: q555{i}z please" for i in range(8)]
    texts += [f"call fallback q555{i}z thanks" for i in range(8)] + ["call fallback q999z thanks"]
    assert found(spark, texts)[len(texts) - 1] == [("phone", "q999z")]


def test_base_spans_without_three_digits_are_seeds(spark):
    texts = [f"node 10.0.0.{i} up" for i in range(40)] + ["node 10.0.0.777x up"]
    assert found(spark, texts)[40] == [("ip", "10.0.0.777x")]
