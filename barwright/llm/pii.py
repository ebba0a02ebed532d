"""Personal data by fixed shapes plus bootstrapped contexts, in SQL functions only.

Spans of the fixed shapes, and long keys of mixed letters and digits, are the seeds. The lexemes before
and after seeds and other identifier-like tokens make patterns: up to three before, up to two after.
Patterns and instances form a bipartite graph over which Spark passes scores for a few rounds; what a
round is sure of is a seed of the next. Instances that trusted patterns agree on become spans of their
own. Texts are read once; the rounds work on a stored table of instances, to which only documents with a
fixed-shape span, three digits or an ``@`` contribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import bound, found_spans, scan, stored

KINDS = ("email", "ip", "card", "phone")
#: The fixed shapes; possessive where giving back could never help, and not tried within a run that failed.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text that a shape cannot do without.
GATES = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: The kind that only contexts prove: its seeds are long keys.
SECRET, KEY = "secret", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{32,}$"
EVERY_KIND = (*KINDS, SECRET)
#: An identifier-like token: letters, digits and inner joints, with three digits or an ``@``.
INSTANCE = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9._+/:-]*@|(?:[A-Za-z._+/:-]*[0-9]){3})[A-Za-z0-9](?:[A-Za-z0-9@._+/:-]*[A-Za-z0-9])?+"
#: What patterns are made of: runs of letters and digits, and single other characters.
LEXEME = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BEFORE, AFTER = 3, 2
REACH = 60
#: Characters of a piece in which contexts are looked up, as finding a place in a text takes time in proportion to it.
PIECE = 1024
ROUNDS = 3
#: A pattern needs so many distinct seed texts and such a share of its instances; a span such a score.
MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 3, 0.8, 0.9

_SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    doubled = F.array(*(F.lit(2 * i - 9 * (i > 4)) for i in range(10)))
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.get(doubled, d.cast("int"))).otherwise(d.cast("int")))
    return F.length(digits).between(12, 19) & (F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0)


def _shape_spans(kind: str, text: Column) -> Column:
    kept = F.filter(found_spans(text, SHAPES[kind]), lambda s: _valid(kind, s["text"]))
    named = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    gate = F.contains(text, F.lit(GATES[kind])) if GATES[kind] else F.lit(True)
    return F.when(gate, named).otherwise(F.array().cast(_SPANS))


def _ordered(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")))


def base_spans(text: Column) -> Column:
    """Spans of the fixed shapes by start, then kind as in ``KINDS``; code points, end exclusive."""
    every = F.concat(*(_ordered(_shape_spans(kind, text), n) for n, kind in enumerate(KINDS)))
    ordered = F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return F.when(text.rlike("[0-9@]"), ordered).otherwise(F.array().cast(_SPANS))


def _with_context(text: Column, spans: Column) -> Column:
    """``spans`` with the last ``BEFORE`` lexemes before and the first ``AFTER`` ones after, lower-cased, nearest first."""
    padded = F.concat(F.lit(" " * REACH), text)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(padded, i * PIECE + 1, F.lit(PIECE + 2 * REACH)))

    def lexemes(part: Column) -> Column:
        return F.regexp_extract_all(F.lower(part), F.lit(LEXEME), F.lit(0))

    def one(ps: Column, s: Column) -> Column:
        low, high = s["start"], s["end"]
        ahead = F.substring(F.get(ps, F.floor(low / PIECE).cast("int")), low % PIECE + 1, F.lit(REACH))
        behind = F.substring(F.get(ps, F.floor(high / PIECE).cast("int")), high % PIECE + REACH + 1, F.lit(REACH))
        return F.struct(
            s["kind"].alias("kind"), low.alias("start"), high.alias("end"), F.lower(s["text"]).alias("text"),
            F.slice(F.reverse(lexemes(ahead)), 1, BEFORE).alias("before"), F.slice(lexemes(behind), 1, AFTER).alias("after"),
        )

    return bound(pieces, lambda ps: F.transform(spans, lambda s: one(ps, s)))


def _free(base: Column, tokens: Column) -> Column:
    """Those of ``tokens`` that overlap no base span: one pass for those that begin before a token, one, from the end, for the others."""
    kind = lambda spans, isbase: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(isbase).alias("own"), s["end"].alias("end"), s["text"].alias("text")))
    none = F.array().cast("array<struct<start:int,own:int,end:int,text:string>>")
    both = F.array_sort(F.concat(kind(base, 0), kind(tokens, 1)))
    left = scan(both, F.lit(0), lambda at, x: F.when(x["own"] == 0, F.greatest(at, x["end"])).otherwise(at), lambda at, x: F.when((x["own"] == 0) | (at <= x["start"]), F.array(x)).otherwise(none), none)
    far = F.lit((1 << 31) - 1)
    right = scan(F.reverse(left), far, lambda at, x: F.when(x["own"] == 0, x["start"]).otherwise(at), lambda at, x: F.when((x["own"] == 1) & (at >= x["end"]), F.array(x)).otherwise(none), none)
    named = F.when(F.size(base) > 0, right).otherwise(kind(tokens, 1))
    return F.transform(named, lambda s: F.struct(F.when(s["text"].rlike(KEY), SECRET).otherwise("").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``base`` and ``found``, arrays of ``(kind, start, end, text)``.

    ``base`` holds the fixed shapes' spans, ``found`` the further ones that trusted patterns point
    to (never overlapping a base span; a tie between kinds goes to the first of ``EVERY_KIND``). Null text
    is empty; repeated rows get equal results each. Only the identifier and the text are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h")).withColumn("base", base_spans(F.col("t")))
    context = "array<struct<kind:string,start:int,end:int,text:string,before:array<string>,after:array<string>>>"
    every = F.concat("base", _free(F.col("base"), found_spans(F.col("t"), INSTANCE)))
    instances = F.when((F.size("base") > 0) | F.col("t").rlike("[0-9][^0-9]?[0-9]|@"), _with_context(F.col("t"), every)).otherwise(F.array().cast(context))
    rows = stored(read.select("id", "h", "base", instances.alias("instances")))
    found = _bootstrap(rows, rounds, min_seeds, min_confidence, min_score)
    own = rows.select("id", "h", "base")
    joined = own.join(found, own["id"].eqNullSafe(found["fid"]) & (own["h"] == found["fh"]), "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("found", F.array().cast(_SPANS)).alias("found"))


def _bootstrap(rows: DataFrame, rounds: int, min_seeds: int, min_confidence: float, min_score: float) -> DataFrame:
    """Spans of instances that trusted patterns agree on: ``fid, fh, found``.

    A pattern is a side and its nearest lexemes; its trust in a kind is the share of its instances'
    scores for that kind, given enough distinct seed texts: those of the shapes, and from the second
    round on those that scored ``min_score`` in the round before. An instance's score is the noisy-or of
    the most trusted pattern of either side.
    """
    exploded = rows.where(F.size("instances") > 0).select("id", "h", F.explode("instances").alias("i"))
    grams = lambda mark, lexemes, most: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size(lexemes) >= n, F.concat(F.lit(mark), F.array_join(F.slice(lexemes, F.lit(1), n), " "))))
    sides = exploded.select(
        "id", "h", F.col("i.kind").alias("kind"), F.col("i.start").alias("start"), F.col("i.end").alias("end"), F.col("i.text").alias("text"),
        F.explode(F.concat(grams("<", F.col("i.before"), BEFORE), grams(">", F.col("i.after"), AFTER))).alias("pattern"),
    ).where("pattern is not null")
    # one row per pattern and instance text: a text repeated over many copies counts once
    edges = stored(sides.groupBy("pattern", "text", "kind").agg(F.count(F.lit(1)).alias("places")))
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    fixed = edges.where("kind <> ''").select("pattern", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed"))
    scores = None
    for turn in range(rounds):
        known = fixed
        if scores is not None:
            # what earlier rounds are sure of is a seed of this one
            gained = edges.where("kind = ''").select("pattern", "text").join(scores, "text")
            known = known.unionByName(gained.select("pattern", "kind", "score", (F.col("score") >= min_score).cast("int").alias("seed")))
        mass = known.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.sum("seed").alias("seeds"))
        trusted = (
            mass.join(totals, "pattern")
            .where((F.col("seeds") >= min_seeds) & (F.col("mass") / F.col("n") >= min_confidence))
            .select("pattern", F.col("kind").alias("as_kind"), (F.col("mass") / F.col("n") * (1 - 1 / (F.col("seeds") + 1))).alias("trust"))
        )
        trusted = stored(trusted)
        best = lambda mark: F.coalesce(F.max(F.when(F.col("pattern").startswith(mark), F.col("trust"))), F.lit(0.0))
        score = (1 - (1 - best("<")) * (1 - best(">"))).alias("score")
        if turn < rounds - 1:
            scores = edges.where("kind = ''").join(trusted, "pattern").groupBy("text", F.col("as_kind").alias("kind")).agg(score)
    hits = sides.where(F.col("kind").isin("", SECRET)).join(trusted, "pattern").groupBy("id", "h", "start", "end", "text", "as_kind").agg(score).where(F.col("score") >= min_score)
    order = F.array_position(F.array(*map(F.lit, EVERY_KIND)), F.col("as_kind"))
    best = hits.groupBy("id", "h", "start", "end").agg(F.max_by(F.struct(F.col("as_kind").alias("kind"), "text"), F.struct("score", -order)).alias("b"))
    return best.groupBy(F.col("id").alias("fid"), F.col("h").alias("fh")).agg(
        F.array_sort(F.collect_set(F.struct("start", F.col("b.kind").alias("kind"), "end", F.col("b.text").alias("text")))).alias("f")
    ).select("fid", "fh", F.transform("f", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias("found"))


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by ``[KIND]``; overlapping spans merge into the first's."""
    marks = spans.select(F.col(id_col).alias("_id"), F.array_sort(F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))).alias("_marks")).dropDuplicates(["_id"])
    joined = docs.alias("d").join(marks.alias("m"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("m._id")), "left")
    given, found, none = F.col(f"d.`{text_col}`"), F.col("m._marks"), F.array().cast("array<string>")
    text = F.coalesce(given, F.lit(""))
    # the text between marks and the marks' names; a mark at the end of the text takes what is left
    ends = F.concat(found, F.array(F.struct(F.length(text).alias("start"), (-F.length(text)).alias("back"), F.lit(None).cast("string").alias("kind"))))
    name = lambda m: F.when(m["kind"].isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")))
    pieces = scan(
        ends, F.lit(0), lambda at, m: F.greatest(at, -m["back"]),
        lambda at, m: F.when(m["start"] >= at, F.array(F.substring(text, at + 1, m["start"] - at), name(m))).otherwise(none), none,
    )
    new = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(given).alias(text_col)
    return joined.select(*(new if c == text_col else F.col(f"d.`{c}`") for c in docs.columns))
