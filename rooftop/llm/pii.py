"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

Everything here is DataFrame functions; no Python runs on the rows.

Base spans are the fixed patterns' matches (email, ip, card, phone), leftmost
and non-overlapping for each kind, in code points.  The patterns are written with
possessive loops and look-behinds, so that a match costs time linear in the
text however long its runs are.

The method then looks for identifiers that the patterns miss:

1. Mentions.  Every token with a digit or an ``@`` is a mention, with the two
   words on each side; so are adjacent groups of digits (``(555) 123-4567``, a
   card in fours), taken together, and addresses with a spelled at (``a(at)b.c``,
   ``a at b dot c``).  Mentions that hold a base match are seeds of its kind; the
   others are unknown.  The tokens of a joined mention have no words of their
   own, and are found where they are identifiers elsewhere.
2. Lexical patterns.  A mention induces the patterns "two words before",
   "word before and after", and "two words after".
3. Graph.  Distinct (pattern, instance) pairs, so copies of a text add nothing.
   In each round a pattern's confidence for a kind is the summed score of that
   kind's instances over all its instances (plus one), given at least
   ``min_support`` of them; an unknown instance's score is the noisy-or of its
   confident patterns, and is carried into the next round.  Rounds go on until one
   (the third at the earliest) adds no accepted instance and no confident
   pattern of an instance.
4. Instances with a score of ``accept`` or more from at least two patterns, whose
   form could be of that kind, are found: their mentions become spans, unless
   they overlap a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_stash, stash

KINDS = ("email", "ip", "card", "phone")
# Base patterns: what is matched is fixed; the loops are possessive and the
# starts anchored, which changes the cost and not the matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that a text can hold a match at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_PARTS = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
# Forms an unknown token must have to be taken for a kind.
FORMS = {"email": r"@|(?i)\bat\b", "ip": r"[0-9][.:][0-9]", "card": r"(?:[0-9][^0-9]?){12}", "phone": r"(?:[0-9][^0-9]{0,2}){7}"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SUM_BLOCK = 128
CHUNK = 1024


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(steps: Column, combine) -> Column:
    """Running ``combine`` (from 0) of an array of ints, by blocks: time n times the block size, not n squared."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), combine)

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / SUM_BLOCK).cast("int")),
                           lambda b: fold(F.slice(s, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))

    def runs(x: Column) -> Column:
        s, by = x["s"], x["by"]
        before = F.transform(by, lambda _, i: fold(F.slice(by, F.lit(1), i)))
        return let(F.struct(s.alias("s"), before.alias("o")), lambda z: F.transform(
            z["s"], lambda _, i: combine(F.get(z["o"], F.floor(i / SUM_BLOCK).cast("int")), fold(
                F.slice(z["s"], F.floor(i / SUM_BLOCK).cast("int") * SUM_BLOCK + 1, i % SUM_BLOCK + 1)))))

    return F.when(F.size(steps) > 0, let(steps, lambda s: let(F.struct(s.alias("s"), blocks(s).alias("by")), runs))) \
        .otherwise(F.array().cast("array<int>"))


def _add(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m string, s int, e int, l string, r string>>: matches, places, and the texts between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    parts = F.struct(found.alias("m"), pieces.alias("p"))

    def placed(x: Column) -> Column:
        m, p = x["m"], x["p"]
        ends = _running(F.transform(m, lambda w, i: F.length(w) + F.length(F.get(p, i))), _add)
        return let(F.struct(m.alias("m"), p.alias("p"), ends.alias("e")), lambda y: F.transform(
            y["m"], lambda w, i: F.struct(
                w.alias("m"), (F.get(y["e"], i) - F.length(w)).alias("s"), F.get(y["e"], i).alias("e"),
                F.get(y["p"], i).alias("l"), F.get(y["p"], i + 1).alias("r"))))

    return let(parts, placed)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def total(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + let(
            F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda v: F.when(v > 9, v - 9).otherwise(v)))

    return let(x, lambda d: total(d) % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(IP_PARTS)
    n = F.length(digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)


SPAN_TYPE = "array<struct<k: int, s: int, e: int>>"


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e>> ordered by kind, then start; ``text`` must not be null."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda x: valid(kind, x["m"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN_TYPE))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def seed_kind(token: Column) -> Column:
    """The kind of base match that the token holds, by number; null if none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        kind = KINDS[k]
        out = F.when(token.rlike(HINTS[kind]) & valid(kind, F.regexp_extract(token, PATTERNS[kind], 0))
                     & (F.regexp_extract(token, PATTERNS[kind], 0) != ""), F.lit(k)).otherwise(out)
    return out


def document_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit keys of a row's id and text; rows equal in both have equal spans."""
    return F.xxhash64(F.lit(1), id_, text), F.xxhash64(F.lit(2), text, id_)


# Digit groups joined by single spaces, at least 7 digits in 2 to 19 groups; a token that is a whole address
# or card by itself is no group.
_GROUP = r"(?![0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}\.[0-9])(?!(?:[0-9][()./-]*+){13})[0-9][0-9()./-]*+"
_TAIL = r"[^\s\p{L}0-9@]*+"
GROUPS = (r"(?<!\S)[^\s0-9@]*+(?=(?:[0-9][()./-]*+\x20?+\(?+){7})" + _GROUP
          + rf"(?:\x20\(?+{_GROUP}(?={_TAIL}(?:\s|\z))){{1,18}}+" + _TAIL)
# Addresses with a spelled at: bracketed, or a bare word before a domain with a dot, spelled or not.
_DOT = r"(?:\.|\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20)"
AT_FORM = (r"(?i:(?<!\S)[^\s@\p{L}0-9]*+[a-z0-9._%+-]++(?:"
           rf"\x20?[(\[{{<]\x20?at\x20?[)\]}}>]\x20?[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*+"
           rf"|(?<=[a-z][0-9._%+-]{{0,20}})\x20at\x20(?![0-9]++[.:][0-9])[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++)"
           rf"(?![\p{{L}}0-9@_%+]){_TAIL})")
AT_HINT = r"[\x20(\[{<][aA][tT][\x20)\]}>]"
MENTION = "(?:" + PATTERNS["phone"] + ")|" + GROUPS + "|" + AT_FORM + "|" + TOKEN
CORE = r"(?s)[\p{L}0-9@+(].*[\p{L}0-9]"  # a mention less the punctuation around it


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, s, e, inst, kind, l2, l1, r1, r2) of every token with a digit or an @, digit groups and spelled addresses."""
    text = F.coalesce(col(text_col), F.lit(""))
    k1, k2 = document_keys(col(id_col), text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("t")).filter(F.col("t").rlike("[0-9@]") | (F.col("t").rlike(AT_HINT) & F.col("t").rlike(AT_FORM)))

    def near(x: Column) -> Column:
        # words next to the mention; where the last mention is nearer than that, there are fewer
        left = F.filter(F.split(F.lower(x["l"]), r"\s+"), lambda w: w != "")
        right = F.filter(F.split(F.lower(x["r"]), r"\s+"), lambda w: w != "")
        core = F.regexp_extract(x["m"], CORE, 0)
        return let(F.struct(left.alias("a"), right.alias("b"), core.alias("c")), lambda y: F.struct(
            y["c"].alias("inst"), (x["s"] + F.instr(x["m"], y["c"]) - 1).alias("s"),
            F.get(y["a"], F.size(y["a"]) - 2).alias("l2"), F.get(y["a"], F.size(y["a"]) - 1).alias("l1"),
            F.get(y["b"], F.lit(0)).alias("r1"), F.get(y["b"], F.lit(1)).alias("r2")))

    def parts(x: Column) -> Column:
        # the tokens of a joined mention, without words
        none = [F.lit(None).cast("string").alias(c) for c in ("l2", "l1", "r1", "r2")]
        tokens = F.transform(matches(x["m"], TOKEN), lambda p: let(
            F.regexp_extract(p["m"], CORE, 0), lambda c: F.struct(
                c.alias("inst"), (x["s"] + p["s"] + F.instr(p["m"], c) - 1).alias("s"), *none)))
        return F.when(x["m"].contains(" ") & ~x["m"].startswith("+"), tokens)

    def with_parts(x: Column) -> Column:
        whole = F.array(near(x))
        return F.coalesce(F.concat(whole, parts(x)), whole)

    found = rows.select("k1", "k2", F.explode(F.flatten(F.transform(matches(F.col("t"), MENTION), with_parts))).alias("x"))
    return found.select("k1", "k2", "x.s", (F.col("x.s") + F.length("x.inst")).alias("e"), "x.inst",
                        seed_kind(F.col("x.inst")).alias("kind"), "x.l2", "x.l1", "x.r1", "x.r2") \
        .filter((F.length("inst") >= 5) & (F.col("kind").isNotNull() | F.col("inst").contains("@")
                                           | F.col("inst").rlike(AT_FORM) | (F.length(digits(F.col("inst"))) >= 4)))


def pattern_graph(found: DataFrame) -> DataFrame:
    """Distinct (pattern, inst, kind): the lexical patterns around each instance."""
    def pattern(tag: str, a: str, b: str) -> Column:
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws(" ", F.lit(tag), a, b))

    pats = F.array_compact(F.array(pattern("LL", "l2", "l1"), pattern("LR", "l1", "r1"), pattern("RR", "r1", "r2")))
    return found.select(F.explode(pats).alias("pattern"), "inst", "kind").distinct()


def bootstrap(graph: DataFrame, max_rounds: int = 100, min_support: int = 3, min_confidence: float = 0.75,
              accept: float = 0.9) -> DataFrame:
    """(inst, kind) of the unknown instances found, by rounds of scoring patterns and instances.

    Raises if the rounds have not settled after ``max_rounds``.
    """
    graph = stash(graph, "pii-graph")
    seeds = graph.filter(F.col("kind").isNotNull()).select("inst", F.col("kind").alias("k")).distinct() \
        .select("inst", "k", F.lit(1.0).alias("score"), F.lit(2).alias("by"))
    scores = seeds
    per_pattern = graph.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
    accepted = (F.col("score") >= accept) & (F.col("by") >= 2)
    state = None
    for done in range(max_rounds):
        scored = scores.select(F.col("inst").alias("i2"), "k", "score")
        confident = graph.join(scored, F.col("inst") == F.col("i2")).groupBy(F.col("pattern").alias("p2"), "k") \
            .agg(F.sum("score").alias("sum"), F.count("*").alias("support")).filter(F.col("support") >= min_support) \
            .join(per_pattern, F.col("p2") == F.col("pattern")) \
            .select("p2", "k", (F.col("sum") / (F.col("n") + 1)).alias("confidence")) \
            .filter(F.col("confidence") >= min_confidence)
        unknown = graph.filter(F.col("kind").isNull()).join(confident, F.col("pattern") == F.col("p2")) \
            .groupBy("inst", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"),
                                      F.count("*").cast("int").alias("by"))
        # an instance goes on with its best kind only
        best = unknown.groupBy("inst").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "by")).alias("b")) \
            .select("inst", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score"), F.col("b.by").alias("by"))
        old, scores = scores, stash(seeds.unionByName(best), "pii-scores")
        drop_stash(old)
        last, state = state, scores.agg(F.count_if(accepted), F.sum("by")).first()
        if done >= 2 and state == last:
            break
    else:
        raise RuntimeError(f"personal data: the rounds have not settled after {max_rounds}")
    fits = F.lit(False)
    for k, kind in enumerate(KINDS):
        fits = fits | ((F.col("k") == k) & F.col("inst").rlike(FORMS[kind]))
    taken = seeds.select(F.col("inst").alias("seed"))
    return scores.filter(accepted & fits) \
        .join(taken, F.col("inst") == F.col("seed"), "left_anti").select("inst", F.col("k").alias("found_kind"))


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(k1, k2, extra): the spans that the method finds, for each document that has some."""
    m = stash(mentions(docs, id_col, text_col), "pii-mentions")
    found = bootstrap(pattern_graph(m), **settings).withColumnRenamed("inst", "found")
    return m.filter(F.col("kind").isNull()).join(found, F.col("inst") == F.col("found")) \
        .groupBy(F.col("k1").alias("x1"), F.col("k2").alias("x2")) \
        .agg(F.collect_set(F.struct(F.col("found_kind").alias("k"), "s", "e")).alias("extra"))


def _greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _apart(extra: Column, base: Column) -> Column:
    """The ``extra`` spans that overlap no ``base`` span.

    Base spans in the order of their starts and extra ones in that of their ends
    are one sorted row of events; an extra span overlaps if a base span that
    starts before its end ends after its start: one running maximum.
    """
    none = F.lit(0)
    starts = F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("base"), b["e"].alias("reach"),
                                                  none.alias("k"), none.alias("s")))
    ends = F.transform(extra, lambda x: F.struct(x["e"].alias("at"), none.alias("base"), none.alias("reach"),
                                                 x["k"].alias("k"), x["s"].alias("s")))

    def checked(z: Column) -> Column:
        seen = F.transform(z["v"], lambda v, i: F.struct(v.alias("v"), F.get(z["m"], i).alias("m")))
        free = F.filter(seen, lambda x: (x["v"]["base"] == 0) & (x["m"] <= x["v"]["s"]))
        return F.transform(free, lambda x: F.struct(x["v"]["k"].alias("k"), x["v"]["s"].alias("s"), x["v"]["at"].alias("e")))

    events = F.array_sort(F.concat(starts, ends))
    return let(events, lambda v: let(F.struct(v.alias("v"), _running(
        F.transform(v, lambda x: x["reach"]), _greatest).alias("m")), checked))


def _widest(spans: Column) -> Column:
    """Spans that lie in no longer one (a part gives way to the whole).

    By start, the longest first, a span lies in an earlier one if the furthest
    end before it reaches its own; spans of other kinds at the very same place,
    at most one a kind, are passed over.
    """
    def kept(z: Column) -> Column:
        o, m = z["o"], z["m"]

        def same(i: Column, back: int) -> Column:
            return F.coalesce((F.get(o, i)["s"] == F.get(o, i - back)["s"]) & (F.get(o, i)["n"] == F.get(o, i - back)["n"]),
                              F.lit(False))

        def before(i: Column) -> Column:
            out = F.get(m, i - len(KINDS))
            for back in reversed(range(1, len(KINDS))):
                out = F.when(~same(i, back), F.get(m, i - back)).otherwise(out)
            return F.coalesce(out, F.lit(0))

        wide = F.filter(F.transform(o, lambda x, i: F.struct(x.alias("x"), before(i).alias("b"))), lambda y: y["b"] < y["x"]["e"])
        return F.transform(wide, lambda y: F.struct(y["x"]["k"].alias("k"), y["x"]["s"].alias("s"), y["x"]["e"].alias("e")))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"), x["k"].alias("k"))))
    return let(ordered, lambda o: let(F.struct(o.alias("o"), _running(F.transform(o, lambda x: x["e"]), _greatest).alias("m")), kept))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, carry: list[Column], settings: dict) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    k1, k2 = document_keys(col(id_col), text)
    rows = docs.select(*carry, k1.alias("k1_"), k2.alias("k2_"), base_spans(text).alias("base_"))
    extra = stash(found_spans(docs, id_col, text_col, **settings), "pii-found")
    both = rows.join(extra, (F.col("k1_") == F.col("x1")) & (F.col("k2_") == F.col("x2")), "left")
    extra = F.coalesce("extra", F.array().cast(SPAN_TYPE))
    own = F.when(F.size(extra) > 0, let(_apart(extra, F.col("base_")), _widest)).otherwise(F.array().cast(SPAN_TYPE))
    both = both.withColumn("extra", own)
    return both.withColumn("spans_", F.array_sort(F.concat("base_", "extra"))).drop("k1_", "k2_", "x1", "x2", "extra")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    The counts and the hash are of the base spans; ``spans`` has all.  A null
    text is empty and has none.  Ids may be null or repeated: spans belong to
    the pair of id and text.  Other columns are ignored.
    """
    both = _with_spans(docs, id_col, text_col, [col(id_col).alias("id_")], settings)

    def count(k: int) -> Column:
        return F.size(F.filter("base_", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return both.select(F.col("id_").alias(id_col), *counts, F.sha2(spans_text(F.col("base_")), 256).alias("base_sha256"),
                       spans_text(F.col("spans_")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle brackets.

    Spans that overlap are one, under the kind of the one that starts first
    (the longest of those).  Texts without a span, nulls among them, stay as
    they are, and so do all other columns.
    """
    packed = F.struct(*(col(c) for c in docs.columns)).alias("doc_")
    both = _with_spans(docs, id_col, text_col, [packed], settings)
    text = F.col("doc_")[text_col]
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def merged(o: Column) -> Column:
        def runs(x: Column) -> Column:
            o, reach, at = x["o"], x["reach"], x["at"]
            return F.transform(at, lambda i, j: F.struct(
                F.get(o, i)["s"].alias("s"), F.get(reach, F.coalesce(F.get(at, j + 1), F.size(o)) - 1).alias("e"),
                F.get(o, i)["k"].alias("k")))

        def starts(x: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(x["o"]) - 1), lambda i: (i == 0) | (
                F.get(x["o"], i)["s"] >= F.get(x["reach"], i - 1)))
            return let(F.struct(x["o"].alias("o"), x["reach"].alias("reach"), at.alias("at")), runs)

        reach = _running(F.transform(o, lambda x: x["e"]), _greatest)
        return let(F.struct(o.alias("o"), reach.alias("reach")), starts)

    def rebuilt(r: Column) -> Column:
        # the text is cut into pieces once, so a stretch of it costs its own length and not its place
        def whole(chunks: Column) -> Column:
            def stretch(a: Column, b: Column) -> Column:
                first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
                return F.when(first == last, F.substring(F.coalesce(F.get(chunks, first), F.lit("")), a % CHUNK + 1, b - a)) \
                    .otherwise(F.concat(F.substring(F.get(chunks, first), a % CHUNK + 1, F.lit(CHUNK)),
                                        F.array_join(F.slice(chunks, first + 2, last - first - 1), ""),
                                        F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), b % CHUNK)))

            heads = F.transform(r, lambda x, j: let(F.coalesce(F.get(r, j - 1)["e"], F.lit(0)), lambda done: F.concat(
                stretch(done, x["s"]), F.get(names, x["k"]))))
            return F.concat(F.array_join(heads, ""), stretch(F.element_at(r, -1)["e"], F.length(text)))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), whole)

    ordered = F.array_sort(F.transform("spans_", lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"), x["k"].alias("k"))))
    clean = F.when(F.size("spans_") > 0, let(let(ordered, merged), rebuilt)).otherwise(text)
    return both.select(*(clean.alias(c) if c == text_col else F.col("doc_")[c].alias(c) for c in docs.columns))
