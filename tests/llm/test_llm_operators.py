"""Training-data operators against brute force on small inputs with nulls, copies, ties and long texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import blocks, chat_format, common, decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, packing, pii, quality, url_filter

DOCS = "doc_id long, text string, lang string, gone string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, start=0):
    return spark.createDataFrame([(None if t == "NOID" else i + start, t, "en", "x") for i, t in enumerate(texts)], DOCS)


def words(rnd, n):
    return " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) + rnd.choice("xyz") for _ in range(n))


def near_texts(seed=3, base=12):
    rnd = random.Random(seed)
    out = []
    for _ in range(base):
        text = words(rnd, rnd.randint(2, 120))
        out.append(text)
        for _ in range(rnd.randint(0, 6)):
            own = text.split()
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = "changed"
            out.append(" ".join(own))
    return out


# exact dedup -----------------------------------------------------------------------------------------


def test_trie_holds_prefixes_and_spills():
    trie = exact_dedup.PatriciaTrie(2000)
    texts = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc"] + [bytes([65 + i % 20]) * (i + 1) for i in range(40)]
    found = []
    for i, t in enumerate(texts):
        trie.insert(t, i, 1)
        if trie.overfull():
            found += trie.spill()
    found += trie.drain()
    total = defaultdict(int)
    for t, _, n in found:
        total[t] += n
    assert total == {t: texts.count(t) for t in texts}


def test_exact_duplicates(spark):
    texts = ["a  b", "a\tb", None, "", "  ", "c", "NOID", "a b", "c" * 100_000]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(docs(spark, texts), max_trie_bytes=500).collect()}
    assert len(got) == len(texts)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        if texts[i] == "NOID":
            continue
        r = got[i, hashlib.sha256(t.encode()).hexdigest()]
        same = [j for j, u in enumerate(norm) if u == t]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), i == min(same))
    assert exact_dedup.keep_first(docs(spark, texts)).count() == len(set(norm))
    assert exact_dedup.exact_duplicates(docs(spark, []).limit(0)).count() == 0


# near duplicates ------------------------------------------------------------------------------------------


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "num", "den", "cold"), [(4, 85, 100, 16), (5, 80, 100, 2), (2, 70, 100, 2)])
def test_jaccard_components_match_brute_force(spark, k, num, den, cold):
    texts = [*near_texts(), None, "", "one", "One", "two words", "x " * 5000]
    passage = words(random.Random(9), 40)
    texts += [f"{passage} {words(random.Random(i), 6)}" for i in range(30)]  # a crowd around one passage
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs(spark, texts), k=k, num=num, den=den, max_cold=cold).collect()}
    assert got == dict(enumerate(brute_components(texts, k, num, den)))


def test_jaccard_moves_no_sets_of_pairs_that_parity_bits_tell_apart(spark, monkeypatch):
    """Variants of a text that share enough signatures to meet, near and far from the threshold: the far ones' sets are never made."""
    rnd, moved, items = random.Random(3), [], jaccard_join._items
    base = words(rnd, 300).split()
    texts = [" ".join([*base[: 300 - 60 * j], *words(rnd, 60 * j).split()]) for j in range(4)]
    texts += [f"{texts[0]} more", f"{texts[3]} more"]

    def counted(read, owners, k):
        moved.append(owners.count())
        return items(read, owners, k)

    monkeypatch.setattr(jaccard_join, "_items", counted)
    found = jaccard_join._verified(
        spark.createDataFrame([(a, b) for b in range(6) for a in range(b)], "a int, b int").join(marks := fingerprints(spark, texts), F.col("id") == F.col("a")).drop("a", "id").withColumnRenamed("fp", "x")
        .join(marks, F.col("id") == F.col("b")).select(F.col("x").alias("a"), F.col("fp").alias("b")),
        marks.withColumn("n", F.lit(300).cast("bigint")), docs(spark, texts).select(F.col("doc_id").alias("id"), "text"), 4, 85, 100,
    )
    assert found.count() == 2 and moved == [4]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs(spark, texts), k=4, num=85, den=100).collect()}
    assert got == dict(enumerate(brute_components(texts, 4, 85, 100)))


def fingerprints(spark, texts):
    sets = [jaccard_join.shingle_sets(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]), 4)[0] for t in texts]
    return spark.createDataFrame([(i, int(jaccard_join._fingerprints(x, np.array([0, len(x)]))[0])) for i, x in enumerate(sets)], "id long, fp long")


@pytest.mark.parametrize("num", [85, 40])
def test_parity_bits_lose_no_similar_set(spark, num):
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))]
    for n in (1, 30, 31, 60, 64, 129, 300, 1000):
        base = rnd.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(np.r_[base[rnd.random(n) > share], rnd.integers(0, 2**63, int(n * share)).astype(np.uint64)]) for share in (0, 0.03, 0.08, 0.1, 0.3, 0.6)]
    sets = [x for x in sets if len(x)]
    words, first = jaccard_join.parity_bits(*jaccard_join._flat(sets))
    marks = spark.createDataFrame([(i, len(x), words[first[i] : first[i + 1]].astype(np.int64).tolist()) for i, x in enumerate(sets)], "fp long, n int, bits array<bigint>")
    differ = lambda x, y: len(x) + len(y) - 2 * len(np.intersect1d(x, y))
    pairs = marks.alias("x").join(marks.alias("y"), F.col("x.fp") < F.col("y.fp")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.bits").alias("xa"), F.col("y.bits").alias("xb"))
    apart = {(r.a, r.b): r.d for r in pairs.select("a", "b", jaccard_join._apart("xa", "xb").alias("d")).collect()}
    assert all(d <= differ(sets[a], sets[b]) for (a, b), d in apart.items())
    like = {i for p in apart for i in p if differ(sets[p[0]], sets[p[1]]) * (100 + num) <= (len(sets[p[0]]) + len(sets[p[1]])) * (100 - num)}
    rows = spark.createDataFrame([(7, i, i) for i in range(len(sets))], "sig long, n long, root long")
    for size in (512, 8):
        left = sorted(r.n for r in blocks.sieved_blocks(rows, marks, num, 100, size).collect())
        assert len(left) == len(set(left)) and like <= set(left) and (0 in left) == (num < 50)


def test_jaccard_without_identifier_or_rows(spark):
    got = jaccard_join.similar_components(docs(spark, ["a b c d e f", "NOID", "a b c d e f"])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got if r.doc_id is not None) == [(0, 0), (2, 0)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.similar_components(docs(spark, ["a"]).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (7, None), (10, 2), (10, 2)], "src long, dst long")
    assert sorted(map(tuple, common.components(edges).collect())) == [(3, 2), (4, 2), (5, 2), (9, 8), (10, 2)]


# lines ------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rnd = random.Random(5)
    long = words(rnd, 40)
    texts = [f"{long}\nshort\n\nalone here", f"short\n{long} more", None, "", f"{words(rnd, 30)}\n\nshort", long.replace("x", "x", 1)]
    got = {(r.doc_id, r.pos): (r.first_doc, r.first_pos) for r in line_dedup.repeated_lines(docs(spark, texts)).collect()}
    assert got == {(1, 0): (0, 1), (1, 1): (0, 0), (4, 2): (0, 1), (5, 0): (0, 0)}
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert clean[1] == "" and clean[4].endswith("\n") and clean[2] is None and clean[0] == texts[0]
    assert line_dedup.repeated_lines(docs(spark, ["a"]).limit(0)).count() == 0


def test_line_dedup_follows_every_crowded_band(spark):
    """A large family around one line: what meets in any band and is similar ends in one class."""
    rnd = random.Random(11)
    hub = words(rnd, 40)
    variants = []
    for i in range(60):
        at = rnd.choice([n for n, c in enumerate(hub) if c != " "])
        variants.append(hub[:at] + chr(0x100 + i) + hub[at + 1 :])
    family = [hub, *variants]
    raw = [t.encode() for t in family]
    own, hashes = line_dedup.band_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert len(own) == len(family)
    bands = [{*x} for x in hashes.tolist()]
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in family]
    with_hub = [i for i in range(1, len(family)) if bands[0] & bands[i] and len(sets[0] & sets[i]) >= 0.8 * len(sets[0] | sets[i])]
    assert len(with_hub) > 50
    got = {r.doc_id: r.first_doc for r in line_dedup.repeated_lines(docs(spark, family)).collect()}
    assert {i: got.get(i) for i in with_hub} == dict.fromkeys(with_hub, 0)


def test_line_dedup_signs_long_lines_without_spaces(spark):
    """Near copies of long lines without words: ideographs, URLs, base64, cells between tabs."""
    rnd = random.Random(13)
    alphabets = ["".join(chr(0x4E00 + i) for i in range(900)), "abcdefghijklmnop/-_%=&", "ABCDEFGHIJabcdefghij0123456789+/", "abcdefgh\t"]
    texts = ["".join(rnd.choice(alphabets[i % 4]) for _ in range(rnd.randint(150, 400))) for i in range(24)]
    copies = [t[: (at := rnd.randrange(len(t)))] + "#" + t[at + 1 :] for t in texts]
    got = {r.doc_id: r.first_doc for r in line_dedup.repeated_lines(docs(spark, [*texts, *copies])).collect()}
    assert got == {24 + i: i for i in range(24)}


def line_classes_by_brute_force(lines):
    """Smallest index of each line's class, and the linked pairs."""
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    root, links = list(range(len(lines))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if lines[i] == lines[j] or sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(lines))], links


@pytest.mark.parametrize("max_band", [16, 1])
def test_line_dedup_against_brute_force(spark, max_band):
    """Templates whose slots differ, near copies around the threshold, many scripts: recall of at least 0.95 and no false link."""
    rnd = random.Random(17)
    lines = []
    for t in range(5):
        frame = [words(rnd, 12), words(rnd, 10)]
        lines += [f"{frame[0]} {words(rnd, 1 + t * 2)} {frame[1]}" for _ in range(50)]
    for script in ("abcdefghij -", "\u4e00\u4e01\u4e02\u4e03\u4e04\u4e05\u4e06\u4e07", "0123456789\t,"):
        for _ in range(20):
            line = "".join(rnd.choice(script) for _ in range(rnd.randint(4, 200)))
            for _ in range(3):
                edited = list(line)
                for _ in range(rnd.randint(0, 3)):
                    edited[rnd.randrange(len(edited))] = rnd.choice(script)
                lines.append("".join(edited))
    rnd.shuffle(lines)
    lines = [t for t in lines if t.strip()]
    want, links = line_classes_by_brute_force(lines)
    classes = {i: r for i, r in enumerate(want) if r != i}
    got = {r.doc_id: r.first_doc for r in line_dedup.repeated_lines(docs(spark, lines), max_band=max_band).collect()}
    assert links > 500 and all(i in classes for i in got)
    assert len(got) >= 0.95 * len(classes)
    assert sum(got.get(i) == r for i, r in classes.items()) >= 0.9 * len(classes)


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Crowded bands, the last step's blocks included, without Python on the executors; short lines and lines that nothing cuts are signed by runs."""

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    frame = spark.range(0)
    for kind, names in ((type(frame), ("mapInArrow", "mapInPandas")), (type(frame.groupBy()), ("applyInPandas", "applyInArrow"))):
        for name in names:
            monkeypatch.setattr(kind, name, refused)
    rnd = random.Random(19)
    hub = words(rnd, 40)
    places = [n for n, c in enumerate(hub) if c != " "]
    edited = lambda text, *at: "".join("#" if i in at else c for i, c in enumerate(text))
    family = [hub, *(edited(hub, rnd.choice(places[10:])) for _ in range(30))]
    uncut = "".join(rnd.choice("bcdefghij") for _ in range(90))
    texts = [*family, uncut, edited(uncut, 45), "twelve chars!", "twelve chars", "c" * 30, "c" * 50]
    want, _ = line_classes_by_brute_force(texts)
    got = {r.doc_id: r.first_doc for r in line_dedup.repeated_lines(docs(spark, texts), max_band=1).collect()}
    assert got == {i: r for i, r in enumerate(want) if r != i} and len(got) >= 32


def test_line_dedup_bands_hold_features_only(spark):
    """Lines of eight features, one of them common to all, share no band: a band of fewer features would bring them all together."""
    rnd = random.Random(23)
    common_one = rnd.randrange(1 << 62)
    rows = [(i, [common_one, *(rnd.randrange(1 << 62) for _ in range(7))]) for i in range(200)]
    signed = line_dedup._banded(spark.createDataFrame(rows, "h long, features array<long>"), F.col("features"), 0, 9, 4).collect()
    held = defaultdict(set)
    for r in signed:
        for sig in r.sigs:
            held[sig].add(r.h)
    assert len(signed) == 200 and max(map(len, held.values())) == 1


def test_line_dedup_with_clashing_names(spark):
    own = spark.createDataFrame([(1, "same line here\nother", "a", "b", "c"), (2, "same line here", "d", "e", "f")], "doc_id long, text string, _id string, _gone string, h string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(own).collect()}
    assert got[2].text == "" and (got[2]._id, got[2]._gone, got[2].h) == ("d", "e", "f") and got[1].text == "same line here\nother"


# benchmark ---------------------------------------------------------------------------------------------------


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(8)
    items = [words(rnd, n) for n in (30, 12, 5, 3, 1, 60)] + [None, "..."]
    texts = [words(rnd, 200) for _ in range(8)] + [f"{words(rnd, 30)} {t.upper()} {words(rnd, 9)}" for t in items[:6]] + [items[0][: len(items[0]) // 2], None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained_items(docs(spark, texts), bench).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = set()
    for j, item in enumerate(items):
        w = split(item)
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i, t in enumerate(texts):
            d = split(t)
            shared = len(s & {tuple(d[x : x + k]) for x in range(len(d) - k + 1)}) if s else 0
            if s and shared >= 0.8 * len(s) - 1e-9:
                want.add((i, j, len(s), shared))
    assert got == want and len(want) >= 6
    assert decontaminate.drop_contaminated(docs(spark, texts), bench).count() == len(texts) - len({i for i, *_ in want})
    assert decontaminate.contained_items(docs(spark, texts), bench.limit(0)).count() == 0


# chats ---------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s> [\\INST", " [/INST]</s>\n", "", None, "plain", "<s>[INST user] x [/INST]</s>\n<s>[INST assistant] y"]
    rows = [(c, i, "assistant" if i % 2 else "us]e\nr%5D<", t) for c in range(2) for i, t in enumerate(nasty[c:])] + [(7, 0, None, "a"), (7, 0, "assistant", "b"), (7, 0, "assistant", "b"), (8, 0, "user", "plain")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.loss_spans(chat_format.format_chats(turns)).collect()}
    assert all(r.round_trip for r in got.values())
    assert [(t.role, t.text) for t in got[0].parsed] == [(r or "", t or "") for c, _, r, t in rows if c == 0]
    assert not got[8].escaped and got[0].escaped and len(got[7].parsed) == 3
    span = got[7].loss_mask[0]
    assert got[7].formatted[span.start : span.end] == "b"


# licences, personal data ------------------------------------------------------------------------------------------


def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-only", "the mit   LICENSE and the MIT license", None, "licensed under CC BY-NC 4.0.", "nothing", "Permission is hereby granted, free of charge, to any person"]
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan_licenses(docs(spark, texts))).collect()}
    assert got[0].labels == "Apache-2.0,apache" and got[0].first_word == 3 and got[0].score == pytest.approx(0.98)
    assert got[1].labels == "GPL-3.0" and got[1].n_base == 0
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].n_words) == (2, 1, 5, 7)
    assert got[3].n_words == 0 and got[3].labels == "" and got[3].first_word is None
    assert got[4].labels == "CC-BY-NC-4.0" and got[6].labels == "MIT" and got[5].score == 0
    assert len(license_scan.rules()) > 200


def test_pii_shapes_and_learned_contexts(spark):
    texts = [f"mail: user{i}@site.com now, badge: 55{i}12{i}x ok. ip 10.0.0.{i} 300.1.1.1 +1 (743) 555-38{i:02d} end" for i in range(6)]
    texts += [f"contact phone: +1 212 555 01{i:02d} please" for i in range(5)] + ["contact phone: 555-9876543 please", None, "", "4111 1111 1111 1111 x 4111111111111112, 4111 1111 1111 1111 4111"]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, texts)).collect()}
    assert [s.kind for s in got[0].base] == ["email", "ip", "phone"]
    text = texts[3]
    for s in got[3].base:
        assert text[s.start : s.end] == s.text
    assert [s.kind for s in got[len(texts) - 1].base] == ["card"]
    learned = got[11].found
    assert [(s.kind, s.text) for s in learned] == [("phone", "555-9876543")]
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts), pii.find_pii(docs(spark, texts))).collect()}
    assert "[EMAIL]" in clean[0] and "@" not in clean[0] and clean[11] == "contact phone: [PHONE] please"


# urls ----------------------------------------------------------------------------------------------------------------


def test_url_rules_by_trie_and_by_join(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de"), ("allow", "org", "/fr/")]
    urls = ["http://a.Example.NET/en/x?q", "http://example.net/de/", "http://example.net", "https://x.example.com/deep/1", "http://example.com/en", "https://b.org/fr/", "no url", None, "http://badexample.com/de/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    trie = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert trie[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and trie[1][2:] == ("net/", "block") and trie[2][2:] == (None, "allow")
    assert trie[3][2:] == ("example.com/de", "block") and trie[4][3] == "allow" and trie[5][2] == "org/fr/" and trie[7][:3] == ("", "", None) and trie[8][2] is None
    joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, max_broadcast=1).collect()}
    assert joined == trie


# packing -------------------------------------------------------------------------------------------------------------------


def test_two_for_one_is_tighter():
    bins = packing.best_two_fit([60, 30, 25, 14], 100)
    assert sorted(sum([60, 30, 25, 14][i] for i in b) for b in bins) == [30, 99]
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 2048) for _ in range(3000)]
    bins = packing.best_two_fit(lengths)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1.02 * sum(lengths) / 2048 + 1


def test_word_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path, rnd = packing.tokenizer_path(), random.Random(4)
    alphabet = "ab'sretvmld  \n\t1\u06632!?'\u00e9\u65e5\u00df\u00b2\u00bd\u00a0\u2003_-.,'S\x1c\x85\u200b\U0001f600"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(5000)]
    texts += ["", "'", "a'", "'s", "x" * 300 + " y", "a <|endoftext|> b", " " * 700 + "z"]
    own, other = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for _ in range(2):  # the second time from its memory
        assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["It's 12 o'clock  <|endoftext|> né", None, "", "日本語 текст ² x", "word " * 3000, "  lead\n\n\ttabs  "]
    own = docs(spark, texts)
    packed = packing.packed_documents(own, path)
    rows = packed.orderBy("doc_id", "piece").collect()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in (r for r in rows if r.doc_id == i):
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    full = packing.materialise(packed, packing.cut(own, path, with_ids=True)).collect()
    assert len(full) == packed.select("sequence_id").distinct().count() and all(len(r.ids) == 2048 for r in full)
    assert packing.packed_documents(own.limit(0), path).count() == 0


# classifier ------------------------------------------------------------------------------------------------------------------


def test_co_training_on_held_out_rows(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shown = labels.where("doc_id % 3 <> 0")
    got = quality.classify(own, shown, rounds=1).join(labels.where("doc_id % 3 = 0"), "doc_id").select("accepted", "quality").collect()
    right = np.mean([r.accepted == (r.quality == 1) for r in got])
    kept = np.mean([r.accepted for r in got if r.quality == 1])
    assert len(got) > 100 and right > 0.95 and kept > 0.98


def test_classifier_without_labels_accepts_all(spark):
    own = docs(spark, ["a", None, ""])
    got = quality.classify(own, spark.createDataFrame([], "doc_id long, quality int"), meta_cols=("lang",)).collect()
    assert len(got) == 3 and all(r.accepted and r.quality_score is None for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = own.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        own = common.stored(stage(spark, own, "/root/testdata/sf0.001"))
        assert own.columns == columns, name
    texts = [r.text for r in own.select("text").collect()]
    assert len({re.sub(r"\s+", " ", t) for t in texts}) == len(texts)
    sizes = brute_components(texts, 5, 80, 100)
    assert all(root == i for i, (_, root) in enumerate(sizes))
    assert own.select(F.countDistinct("doc_id")).first()[0] == len(texts)
