"""License detection by ordered signature rules, in SQL functions only and without a shuffle.

A rule is a regex with a label, a priority and keywords. The keywords gate the rules of a text (and
most texts altogether), on a lower-cased text with single spaces; matches become intervals, and an interval that lies within one of a better
priority, or within a longer one of its own, is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import NON_WORD, found_spans, lower_ascii, scan
from barwright.llm.license_signatures import NOTICES

#: Word characters of texts that are not lower-cased yet.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Licence families: identifier prefix, regex of the name, keywords of which every match holds one (lower case, single spaces, ``|`` between them), versions.
FAMILIES = [
    ("MIT", r"(?:MIT|Expat|X11)", "mit|expat|x11", [""]),
    ("Apache", r"Apache", "apache", ["2.0", "1.1", "1.0"]),
    ("GPL", r"(?:GNU\s+)?(?:General\s+Public|GPL)", "general public|gpl", ["3.0", "2.0", "1.0"]),
    ("LGPL", r"(?:GNU\s+)?(?:Lesser|Library)\s+General\s+Public", "general public", ["3.0", "2.1", "2.0"]),
    ("AGPL", r"(?:GNU\s+)?Affero\s+General\s+Public", "affero", ["3.0", "1.0"]),
    ("GFDL", r"(?:GNU\s+)?Free\s+Documentation", "free documentation", ["1.3", "1.2", "1.1"]),
    ("BSD-2-Clause", r"(?:2-clause|Simplified|FreeBSD)\s+BSD", "bsd", [""]),
    ("BSD-3-Clause", r"(?:3-clause|New|Modified|Revised)\s+BSD", "bsd", [""]),
    ("BSD", r"BSD", "bsd", [""]),
    ("ISC", r"ISC", "isc", [""]),
    ("MPL", r"Mozilla\s+Public", "mozilla", ["2.0", "1.1", "1.0"]),
    ("EPL", r"Eclipse\s+Public", "eclipse", ["2.0", "1.0"]),
    ("CDDL", r"Common\s+Development\s+and\s+Distribution", "common development", ["1.1", "1.0"]),
    ("CPL", r"Common\s+Public", "common public", ["1.0"]),
    ("EUPL", r"European\s+Union\s+Public", "european union", ["1.2", "1.1", "1.0"]),
    ("OSL", r"Open\s+Software", "open software", ["3.0", "2.1", "2.0", "1.0"]),
    ("AFL", r"Academic\s+Free", "academic free", ["3.0", "2.1", "2.0", "1.2"]),
    ("Artistic", r"Artistic", "artistic", ["2.0", "1.0"]),
    ("BSL", r"Boost\s+Software", "boost", ["1.0"]),
    ("BUSL", r"Business\s+Source", "business source", ["1.1"]),
    ("SSPL", r"Server\s+Side\s+Public", "server side", ["1.0"]),
    ("Zlib", r"zlib(?:/libpng)?", "zlib", [""]),
    ("PSF", r"(?:Python\s+Software\s+Foundation|PSF)", "python software|psf", ["2.0"]),
    ("PHP", r"PHP", "php", ["3.01", "3.0"]),
    ("OFL", r"(?:SIL\s+)?Open\s+Font", "open font", ["1.1", "1.0"]),
    ("WTFPL", r"Do\s+What\s+The\s+Fuck\s+You\s+Want\s+To\s+Public", "do what the", ["2.0"]),
    ("MS-PL", r"Microsoft\s+Public", "microsoft", [""]),
    ("MS-RL", r"Microsoft\s+Reciprocal", "microsoft", [""]),
    ("NCSA", r"(?:University\s+of\s+Illinois/)?NCSA", "ncsa", [""]),
    ("PostgreSQL", r"PostgreSQL", "postgresql", [""]),
    ("OpenSSL", r"OpenSSL", "openssl", [""]),
    ("Ruby", r"Ruby", "ruby", [""]),
    ("Vim", r"Vim", "vim", [""]),
    ("LPPL", r"LaTeX\s+Project\s+Public", "latex project", ["1.3c", "1.2", "1.0"]),
    ("ODbL", r"Open\s+(?:Data\s+Commons\s+Open\s+)?Database", "database", ["1.0"]),
    ("CC-BY", r"(?:CC[\s-]+BY|Creative\s+Commons\s+Attribution)", "cc by|cc-by|cc -|cc- |cc--|commons attribution", ["4.0", "3.0", "2.5", "2.0"]),
    ("CC-BY-SA", r"(?:CC[\s-]+BY-SA|Creative\s+Commons\s+Attribution-Share\s*Alike)", "by-sa|attribution-share", ["4.0", "3.0", "2.5", "2.0"]),
    ("CC-BY-NC", r"(?:CC[\s-]+BY-NC|Creative\s+Commons\s+Attribution-NonCommercial)", "by-nc|attribution-noncommercial", ["4.0", "3.0", "2.5", "2.0"]),
    ("CC-BY-ND", r"(?:CC[\s-]+BY-ND|Creative\s+Commons\s+Attribution-NoDerivs?)", "by-nd|attribution-noderiv", ["4.0", "3.0", "2.5", "2.0"]),
    ("CC-BY-NC-SA", r"(?:CC[\s-]+BY-NC-SA|Creative\s+Commons\s+Attribution-NonCommercial-Share\s*Alike)", "by-nc-sa|noncommercial-share", ["4.0", "3.0", "2.5", "2.0"]),
    ("CC-BY-NC-ND", r"(?:CC[\s-]+BY-NC-ND|Creative\s+Commons\s+Attribution-NonCommercial-NoDerivs?)", "by-nc-nd|noncommercial-noderiv", ["4.0", "3.0", "2.5", "2.0"]),
    ("CC0", r"(?:CC0|Creative\s+Commons\s+Zero)", "cc0|commons zero", ["1.0"]),
]
#: Words of which every text that any rule matches has one (lower case, single spaces).
GATES = [
    "licen", "spdx", "cc by", "cc-by", "cc -", "cc- ", "cc--", "cc0", "creative commons", "creativecommons", "permission", "redistribut", "public domain", "unencumbered", "rights reserved", "eupl",
    "warrant", "copying", "buy me a beer", "x consortium", "rail-m", "sublicense", "open government", "software", "disclaims copyright", "waived all copyright", "copyright holder",
]
#: Score of a detection by priority: identifier tag, grant with a version, grant, name with a version, name, notice.
SCORES = [1.0, 0.98, 0.95, 0.9, 0.8, 0.7]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    regex: str


def rules() -> list[Rule]:
    """The signature rules: every family's versions by every phrasing, in order of priority, then the notices."""
    found = []
    for name, shape, keyword, versions in FAMILIES:
        cc = name.startswith("CC")
        tail = "" if cc else r"\s+(?:Public\s+)?Licen[cs]e"
        version = r"(?:\s*,)?\s*(?:v|version)?\s*{}(?![0-9.]*[0-9])"
        end = r"(?![A-Za-z-])"
        grant = r"(?:licen[cs]ed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:an?\s+)?"
        for v in versions:
            label = f"{name}-{v}" if v else name
            exact = version.format(v.replace(".", r"\.").removesuffix(r"\.0") + (r"(?:\.0)?" if v.endswith(".0") else ""))
            found.append(Rule(label, 0, "spdx", rf"SPDX-License-Identifier:\s*{label.replace('.', '[.]')}(?:-only|-or-later|\+)?(?![A-Za-z0-9.-])"))
            if v:
                found += [Rule(label, 1, keyword, grant + shape + tail + exact), Rule(label, 3, keyword, shape + tail + exact)]
        found += [Rule(name, 2, keyword, grant + shape + tail + end), Rule(name, 4, keyword, r"(?<![A-Za-z])" + shape + tail + end)]
    found += [Rule(label, 5, keyword, shape.replace(" ", r"\s+")) for label, shape, keyword in NOTICES]
    return sorted(found, key=lambda r: r.priority)


def _detections(text: Column, lowered: Column, chosen: list[Rule]) -> Column:
    """Kept ``array<struct<start,end,priority,label>>`` of one text."""
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keyword.split("|"))).alias("keywords"), F.lit("(?i)" + r.regex).alias("regex")) for r in chosen))
    able = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(lowered, k)))
    each = F.transform(able, lambda r: F.transform(found_spans(text, r["regex"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"))))
    # by start, longest first, best priority first: what contains an interval comes before it
    ordered = F.array_sort(F.array_distinct(F.flatten(each)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    inside = lambda ends, d: F.exists(F.slice(ends, F.lit(1), d["priority"] + 1), lambda e: e >= -d["back"])
    kept = lambda d: F.array(F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label")))
    return scan(
        ordered, F.array(*[F.lit(-1)] * len(SCORES)),
        lambda ends, d: F.transform(ends, lambda e, i: F.when(i == d["priority"], F.greatest(e, -d["back"])).otherwise(e)),
        lambda ends, d: F.when(inside(ends, d), none).otherwise(kept(d)), none,
    )


def _gated(text: Column) -> Column:
    """Lower-cased text in which every run of what the rules' ``\\s`` matches is one space."""
    return F.regexp_replace(F.lower(text), r"[\t\n\x0B\f\r]\s*| \s+", " ")


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), extra_rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, ``n_words``, ``base`` and ``detections``.

    ``base`` has the places (word starts, from 0) and labels of the three fixed phrases;
    ``detections`` the unsuppressed rule matches in code points, by start. Null text is empty; equal
    intervals keep the best priority, then the first label. Only ``keep`` and the text are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = sorted([*rules(), *(extra_rules or [])], key=lambda r: r.priority)
    rows = docs.select(*keep, text.alias("_text"), _gated(text).alias("_low"))
    gates = [*GATES, *(k for r in extra_rules or [] for k in r.keyword.split("|"))]
    gate = F.lit(False)
    for word in gates:
        gate = gate | F.contains("_low", F.lit(word))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    return rows.select(
        *keep,
        F.regexp_count("_text", F.lit(f"{_WORD}+")).cast("long").alias("n_words"),
        F.when(F.contains("_low", F.lit("license")), _base(F.col("_text"))).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("base"),
        F.when(gate, _detections(F.col("_text"), F.col("_low"), chosen)).otherwise(none).alias("detections"),
    )


def _base(text: Column) -> Column:
    """Places where the words of a fixed phrase stand consecutively; each phrase ends with ``license``."""
    words = F.filter(F.split(lower_ascii(text), f"[{NON_WORD}]+"), lambda w: w != "")
    # each word with the two before it, from three evaluations of the words
    before = F.zip_with(F.concat(F.array(F.lit("")), words), F.concat(F.array(F.lit(""), F.lit("")), words), lambda b1, b2: F.struct(b1.alias("b1"), b2.alias("b2")))
    placed = F.transform(F.zip_with(words, before, lambda w, b: F.struct(w.alias("w"), b["b1"].alias("b1"), b["b2"].alias("b2"))), lambda x, i: F.struct(x["w"].alias("w"), x["b1"].alias("b1"), x["b2"].alias("b2"), i.alias("i")))
    labelled = F.transform(
        F.filter(placed, lambda x: F.coalesce(x["w"], F.lit("")) == "license"),
        lambda x: F.when(x["b1"] == "mit", F.struct((x["i"] - 1).alias("at"), F.lit("mit").alias("label")))
        .when(x["b1"] == "apache", F.struct((x["i"] - 1).alias("at"), F.lit("apache").alias("label")))
        .when((x["b1"] == "public") & (x["b2"] == "general"), F.struct((x["i"] - 2).alias("at"), F.lit("gpl").alias("label"))),
    )
    return F.filter(labelled, lambda x: x.isNotNull())


def summary(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digest of ``scan_licenses``: counts, first and last base place, label lists and a score of 0 to 1."""
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))))
    scores = F.array(*map(F.lit, SCORES))
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("detections", lambda d: F.get(scores, d["priority"])), F.when(F.size("base") > 0, F.array(F.lit(0.6))).otherwise(F.array().cast("array<double>"))))
    places = F.transform("base", lambda b: b["at"].cast("long"))
    return scanned.select(
        *keep, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"),
    )
