"""The keyword gates are as wide as the rules behind them."""

import itertools
import re
from re import _constants as C
from re import _parser

import pytest

from barwright.llm import license_scan


def spellings(parsed):
    """Every choice of branches and optional parts of a regex; white space is two line breaks or one blank, look-arounds are left out."""
    parts = []
    for op, arg in parsed:
        if op is C.LITERAL:
            parts.append([chr(arg)])
        elif op in (C.NOT_LITERAL, C.ANY) or op is C.IN and arg[0][0] is C.NEGATE:
            parts.append(["x"])
        elif op is C.IN and arg[0][0] is C.RANGE:
            parts.append([chr(arg[0][1][0])])
        elif op is C.IN:
            parts.append(["\n\n", " "] + [chr(a) for o, a in arg if o is C.LITERAL] if (C.CATEGORY, C.CATEGORY_SPACE) in arg else [chr(a) for o, a in arg if o is C.LITERAL] or ["x"])
        elif op is C.BRANCH:
            parts.append([x for b in arg[1] for x in spellings(b)])
        elif op is C.SUBPATTERN:
            parts.append(spellings(arg[3]))
        elif op is C.MAX_REPEAT:
            once = spellings(arg[2])
            # white space varies as a whole, so that the number of spellings stays small
            parts.append((["\n\n"] if "\n\n" in once else once) + ([""] if arg[0] == 0 else []) + ([x for x in once if x not in ("\n\n", " ")] if "\n\n" in once else []))
        elif op not in (C.ASSERT, C.ASSERT_NOT):
            raise ValueError(op)
    return ["".join(p) for p in itertools.product(*parts)]


def test_every_alternative_passes_its_gates():
    for rule in license_scan.rules():
        if rule.priority in (1, 2, 3):  # a name with more words around it
            continue
        for text in spellings(_parser.parse(rule.regex)):
            assert re.search(rule.regex, text, re.I), (rule, text)
            low = re.sub(r"\s+", " ", text.lower())
            assert any(k in low for k in rule.keyword.split("|")), (rule, text)
            assert any(g in low for g in license_scan.GATES), (rule, text)


@pytest.fixture(scope="module")
def labels(spark):
    texts = list(CASES)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: set(r.labels.split(",")) for r in license_scan.summary(license_scan.scan_licenses(rows)).collect()}


CASES = {
    "under the GNU General\nPublic License, version 3": "GPL-3.0",
    "Permission is\r\n  hereby granted, free of charge, to any person": "MIT",
    "text CC  BY 4.0 text": "CC-BY-4.0",
    "the GPL License": "GPL",
    "the X11 License": "MIT",
    "the Expat\tLicense": "MIT",
    "the PSF License": "PSF",
    "Creative\nCommons Attribution-ShareAlike 4.0": "CC-BY-SA-4.0",
    "Creative Commons Attribution-NoDerivs 3.0": "CC-BY-ND-3.0",
}


def test_wrapped_and_alternative_headers(labels):
    assert {t: want for t, want in CASES.items() if want not in labels[t]} == {}
