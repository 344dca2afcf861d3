"""Personal data by rules and by bootstrapped contextual extraction (DataFrame operations only).

Rules find base entities. These are the seeds: the last words to the left of a seed, the first ones
to its right and the two words round it make lexical patterns for its kind. Identifiers in looser forms, such as "name (at) host (dot) org" or a phone
number without its country code, are candidates; every other number counts against the words
before, behind and round it. Patterns and instances form a bipartite graph that is scored in rounds: a pattern is as
good as the share of its instances that are known, an instance as its patterns together. In each
round instances with good scores count as known wherever they stand, so the words round them make
patterns of their own, as good as any once enough distinct instances stand behind them. Candidates
at good patterns are added to the base spans, which all stay.

The texts are read once; what is found, with its contexts, is written to the shared folder and
all later steps run on that. Pattern counts are combined before the shuffle, and the joins back
carry one row for each distinct pattern and instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.columns import whole_text
from cairnworks.scratch import discard, materialize

KINDS = ("email", "ip", "card", "phone")

#: Java patterns of the base kinds. They match what the plain ones match, in linear time: runs are
#: possessive and start only where a run starts or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms, and where they are looked for at all.
LOOSE = {
    "email": (
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}|＠| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+){1,8}+",
        r"(?i)[\[({]at[\])}]|＠| at  ?[A-Za-z0-9-]{1,63}+ ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]",
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}+){3}+(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+(?![0-9A-Za-z:])",
        r"[0-9A-Fa-f]::|::[0-9A-Fa-f]|\[\.\]|\(\.\)|\[dot\]|\(dot\)|(?:[0-9A-Fa-f]{1,4}:){3}",
    ),
    "card": (r"(?<![0-9])[0-9]{4}+([._/])[0-9]{4}+\1[0-9]{4}+\1[0-9]{4}+(?![0-9])", r"[0-9]{4}[._/][0-9]{4}[._/]"),
    "phone": (
        r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}+(?![0-9.-])",
        r"[0-9][) .-] ?[0-9]{3,4}[ .-][0-9]{3,4}",
    ),
}
#: Any number behind words: evidence against their pattern, where it is no identifier.
NUMBER = r"(?<!\p{L})(?:\p{L}++[^\p{L}0-9]{1,3}+)?\p{L}++[^\p{L}0-9]{0,8}+[0-9]++(?![0-9A-Za-z])"

#: A number with the word before it and the words behind it in its line and sentence.
NUMBER_BEFORE = r"(?<!\p{L})(?:\p{L}++[^\p{L}0-9]{0,8}+)?+(?<![0-9A-Za-z])[0-9]++(?![0-9A-Za-z])[^\p{L}0-9\n.!?]{1,8}+\p{L}++(?:[^\p{L}0-9\n.!?]{1,3}+\p{L}++){0,2}+"

#: The last two words of a text that is read backwards.
LAST_WORDS = r"^[^\p{L}]*+\p{L}++(?:[^\p{L}]++\p{L}++)?+"
#: The first three words of a text, in its line and sentence.
FIRST_WORDS = r"^[^\p{L}0-9\n.!?]{1,8}+\p{L}++(?:[^\p{L}0-9\n.!?]{1,3}+\p{L}++){0,2}+"
#: Matches whose places are summed up at a time.
CHUNK = 128
#: Rounds of scoring, distinct known instances that make a pattern, least score.
ROUNDS = 3
LEAST_SEEDS = 4
LEAST_SCORE = 0.7


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The checks beyond the pattern."""
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _loose_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
        short = F.when(value.contains("::"), (groups >= 1) & (groups <= 7) & F.rlike(value, F.lit("[0-9]")))
        return short.when(value.contains(":"), True).otherwise(valid("ip", F.regexp_replace(value, r"[^0-9]+", ".")))
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 7) & (n <= 15)
    return valid(kind, value)


SPANS = "array<struct<start:int,kind:int,end:int,value:string,words:string,after:string>>"


def _spans(text: Column, pattern: str, kind: int, where: Column) -> Column:
    """Array of (start, kind, end, value, words, after) of the pattern's matches: two words before each, three behind.

    Matches and the stretches between them come from the same pattern; starts are running sums
    of their lengths in code points, first of chunks of matches, then inside each.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    behind = F.zip_with(values, F.slice(gaps, F.lit(2), F.size(values)), lambda v, g: F.struct(v.alias("value"), F.lower(F.regexp_extract(g, FIRST_WORDS, 0)).alias("after")))
    pairs = F.zip_with(behind, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(F.char_length(g).alias("gap"), F.char_length(v["value"]).alias("size"), v["value"].alias("value"), F.lower(F.reverse(F.regexp_extract(F.reverse(g), LAST_WORDS, 0))).alias("words"), v["after"].alias("after")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"), x["words"].alias("words"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def places(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda k: F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)))
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda total, x: total + x["gap"] + x["size"]))
        sums = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        inside = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step)["out"]
        return F.flatten(F.zip_with(chunks, F.slice(sums, F.lit(1), F.size(chunks)), inside))

    found = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, places(p)).otherwise(F.array().cast(SPANS)))[0]
    return F.when(where, found.cast(SPANS)).otherwise(F.array().cast(SPANS))


def _masked(text: Column, pattern: str, check, kind: str, where: Column) -> Column:
    """The text with each match that passes the check blanked out, at equal length."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(gaps, values, lambda g, v: F.concat(g, F.when(v.isNull(), F.lit("")).when(check(kind, v), F.repeat(F.lit("\ufffc"), F.char_length(v))).otherwise(v)))
    return F.when(where, F.array_join(pieces, "")).otherwise(text)


def _checked(spans: Column, check, kind: str) -> Column:
    return F.filter(spans, lambda s: check(kind, s["value"]))


def _held(spans: str, kind: str) -> Column:
    return F.exists(spans, lambda s: s["kind"] == KINDS.index(kind))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, base, loose, numbers), one for each input row: spans, and other numbers with their contexts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t"))
    t = F.col("t")
    has = {
        "email": t.contains("@"),
        "ip": F.rlike(t, F.lit(BASE["ip"])),
        "card": F.rlike(t, F.lit(BASE["card"])),
        "phone": F.rlike(t, F.lit(r"\+[0-9]")),
    }
    base = [_checked(_spans(t, BASE[kind], k, has[kind]), valid, kind) for k, kind in enumerate(KINDS)]
    # each step has a column of its own, so that it is worked out once
    rows = rows.select("doc_id", F.xxhash64("t").alias("text_hash"), F.concat(*base).alias("base"), t.alias("r"))
    for kind in KINDS:
        rows = rows.withColumn("r", _masked(F.col("r"), BASE[kind], valid, kind, _held("base", kind)))
    r = F.col("r")
    for kind in KINDS:
        rows = rows.withColumn(f"might_{kind}", F.rlike(r, F.lit(LOOSE[kind][1])))
    loose = [_checked(_spans(r, LOOSE[kind][0], k, F.col(f"might_{kind}")), _loose_valid, kind) for k, kind in enumerate(KINDS)]
    rows = rows.withColumn("loose", F.concat(*loose))
    for kind in KINDS:
        rows = rows.withColumn("r", _masked(r, LOOSE[kind][0], _loose_valid, kind, F.col(f"might_{kind}")))
    found = lambda pattern: F.when(F.rlike(r, F.lit("[0-9]")), F.array_distinct(F.regexp_extract_all(r, F.lit(pattern), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    words = lambda m: F.lower(F.reverse(F.regexp_extract(F.reverse(F.regexp_replace(m, "[0-9]+$", "")), LAST_WORDS, 0)))
    before = F.transform(found(NUMBER), lambda m: F.struct(F.regexp_extract(m, "[0-9]+$", 0).alias("value"), words(m).alias("words"), F.lit("").alias("after")))
    behind = F.transform(found(NUMBER_BEFORE), lambda m: F.struct(F.regexp_extract(m, "[0-9]+", 0).alias("value"), F.lower(F.regexp_extract(m, r"^\p{L}+", 0)).alias("words"), F.lower(F.regexp_extract(m, r"[0-9]([^0-9]+)$", 1)).alias("after")))
    numbers = F.concat(before, behind)
    # kinds may overlap: places that base spans and candidates share are few, as the former are blanked out
    covered = lambda spans: F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    shared = F.when(F.size("loose") > 0, F.array_intersect(covered("base"), covered("loose"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("numbers", numbers).withColumn("shared", shared)
    apart = lambda s: ~F.exists("shared", lambda p: (s["start"] <= p) & (p < s["end"]))
    return rows.select("doc_id", "text_hash", "base", F.filter("loose", apart).alias("loose"), "numbers")


def _patterns(words: Column, after: Column) -> Column:
    """The last word and the last two to the left, the first two and three to the right, and the two words round the place."""
    words, after = (F.regexp_extract_all(w, F.lit(r"\p{L}+"), F.lit(0)) for w in (words, after))
    left = [F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")) for n in (1, 2)]
    right = [F.when(F.size(after) >= n, F.concat(F.lit("> "), F.array_join(F.slice(after, 1, n), " "))) for n in (2, 3)]
    both = F.when((F.size(words) > 0) & (F.size(after) > 0), F.concat(F.element_at(words, -1), F.lit(" <> "), F.get(after, F.lit(0))))
    return F.array_compact(F.array(*left, *right, both))


def _edges(found: DataFrame) -> DataFrame:
    """Distinct (pattern, kind, value, seed): kind -1 stands for numbers that are no identifiers."""

    def tag(spans: str, seed: bool) -> Column:
        kind = lambda s: F.lit(-1) if spans == "numbers" else s["kind"]
        return F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["value"].alias("value"), s["words"].alias("words"), s["after"].alias("after"), F.lit(seed).alias("seed")))

    tagged = found.select(F.explode(F.concat(tag("base", True), tag("loose", False), tag("numbers", False))).alias("s"))
    return tagged.select(F.explode(_patterns(F.col("s.words"), F.col("s.after"))).alias("pattern"), "s.kind", F.xxhash64("s.value").alias("value"), "s.seed").distinct()


def good_patterns(edges: DataFrame) -> DataFrame:
    """Rows (pattern, kind, score) of the patterns that lead to identifiers, from rows of :func:`_edges`.

    A pattern's score is the share of its distinct instances that are known: seeds, and
    candidates by their own score. It is good from ``LEAST_SCORE`` on where at least ``LEAST_SEEDS``
    of them are seeds or candidates of that score.
    """
    seeds = edges.where("seed").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_seeds"))
    all_ = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n_all"))
    loose = edges.where("not seed and kind >= 0").select("pattern", "kind", "value")
    kinds = edges.where("kind >= 0").select("pattern", "kind").distinct()
    patterns = materialize(kinds.join(seeds, ["pattern", "kind"], "left").join(all_, "pattern").select("pattern", "kind", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), "n_all"), "patterns")
    # a value that a seed has too is a seed behind its pattern already
    links = materialize(loose.join(edges.where("seed").select("pattern", "kind", "value"), ["pattern", "kind", "value"], "left_anti"), "candidate-links")

    def scored(rows: DataFrame, gained: Column, promoted: Column) -> DataFrame:
        share = F.least(F.lit(1.0), (F.col("n_seeds") + gained) / F.col("n_all"))
        return rows.select("pattern", "kind", F.when(F.col("n_seeds") + promoted >= LEAST_SEEDS, share).otherwise(0.0).alias("score"), (F.col("n_seeds") + promoted).alias("known"))

    scores = scored(patterns, F.lit(0.0), F.lit(0))
    for _ in range(ROUNDS):
        behind = links.join(scores.where("score > 0"), ["pattern", "kind"])
        values = behind.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("score"))))).alias("value_score"))
        gains = links.join(values, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("value_score").alias("gained"), F.count(F.when(F.col("value_score") >= LEAST_SCORE, 1)).alias("promoted"))
        held = scores
        scores = materialize(scored(patterns.join(gains, ["pattern", "kind"], "left"), F.coalesce("gained", F.lit(0.0)), F.coalesce("promoted", F.lit(0))), "pattern-scores")
        discard(held)
    good = materialize(scores.where(F.col("score") >= LEAST_SCORE).select("pattern", "kind", "score"), "good-patterns")
    for table in (patterns, links, scores):
        discard(table)
    return good


def discover(found: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, added): spans of candidates that good patterns lead to."""
    edges = materialize(_edges(found), "pattern-instances")
    good = good_patterns(edges).select("pattern", "kind")
    discard(edges)
    spans = found.where(F.size("loose") > 0).select("doc_id", "text_hash", F.explode("loose").alias("s"))
    spans = spans.select("doc_id", "text_hash", F.explode(_patterns(F.col("s.words"), F.col("s.after"))).alias("pattern"), F.col("s.kind").alias("kind"), "s")
    return spans.join(good, ["pattern", "kind"]).groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("added"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base, spans), arrays of (start, kind, end, value), one for each input row.

    ``base`` holds the rules' matches: per kind the leftmost, non-overlapping ones that pass the
    checks. ``spans`` holds those and what patterns add; added spans never overlap base ones.
    Both are sorted by start, then kind (an index of KINDS); places are code points, ends
    exclusive. Null text counts as empty. Rows with equal id and text get equal results; null
    ids pass through; other columns are not read; an empty table gives an empty result.
    """
    found = materialize(find(docs, id_col, text_col), "identifiers")
    added = discover(found).alias("b")
    a = found.select("doc_id", "text_hash", "base").alias("a")
    both = a.join(added, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    brief = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    extra = F.coalesce(F.col("b.added"), F.slice(F.col("a.base"), 1, 0))
    return both.select(
        F.col("a.doc_id").alias("doc_id"),
        F.array_sort(F.transform("a.base", brief)).alias("base"),
        F.array_sort(F.transform(F.concat("a.base", extra), brief)).alias("spans"),
    )


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
