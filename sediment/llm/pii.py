"""Personal data: strict patterns, and contexts bootstrapped from them that reveal further identifiers.

Strict spans (email, ip, card, phone) are the seeds. Loosely shaped candidates (an address without a domain
ending, a number of 7 to 19 digits, four dotted numbers) are taken from every text too. A lexical pattern is
a class of shape with the words around: the two words before, the word before and the word after, or a label
that ends in ``:`` or ``=``. Patterns and instances form a bipartite graph; in each round a pattern's
precision is the mean score of its instances, and an instance's score is the chance that one of its precise
patterns is right. A pattern is backed by its instances of a high score, strict or discovered in an earlier round, so
contexts that only discovered identifiers share are learned too. Scores never fall; rounds end when none becomes high.
Candidates with a high score become spans wherever they occur; strict spans always stay.

The strict expressions are written with possessive and bounded forms that find the same spans as the plain
ones (see the tests) in time linear in the text. Everything is DataFrame operations. A null or empty text has
no spans; a null id is kept as it is; rows with equal ids are told apart by a row number that is written
before it is used; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, let, scratch, stage

KINDS = ("email", "ip", "card", "phone")
#: In order: the kinds, then the classes of candidates.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+(?=[0-9])(?:[ ().-]*+[0-9]){9,15}+(?![ ().-]*+[0-9])",
    "loose_email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+",
    "loose_number": r"(?<![A-Za-z0-9.+-])\+?\(?[0-9](?:[ ().-]{0,3}+[0-9]){6,18}+(?![A-Za-z0-9])",
}
#: A text is searched only if this holds.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "loose_email": r"@|[\[(]at[\])]", "loose_number": r"[0-9]"}
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Characters of context, least rounds, distinct instances and precision that a pattern needs, score that a candidate needs.
CONTEXT, ROUNDS, SUPPORT, PRECISION, SCORE = 80, 3, 3, 0.8, 0.7
#: Code points of the blocks that a text is cut into to be put together anew.
STEP = 4096


def _luhn(text: Column) -> Column:
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))

    def value(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, text: Column) -> Column:
    return F.when(kind == "ip", text.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")).when(kind == "card", _luhn(text)).otherwise(True)


def _matches(kind: str, text: Column) -> Column:
    """Array of the matches of a kind, each with the gap before it and the text around."""
    pattern = EXPRESSIONS[kind]

    def rows(gaps: Column) -> Column:
        return let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda found: F.transform(
                found,
                lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")),
            ),
        )

    kind_of = "struct<kind:string,i:int,gap:int,match:string,before:string,after:string>"
    return F.when(text.rlike(NEEDS[kind]), let(F.split(text, pattern, -1), rows)).otherwise(F.array().cast(f"array<{kind_of}>"))


def _spans(rows: DataFrame) -> DataFrame:
    """start and end, in code points, of each match."""
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("match")).over(before), F.lit(0)) + F.col("gap")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("match"))


def _apart(base: DataFrame, loose: DataFrame) -> DataFrame:
    """The loose spans that overlap no base span."""
    both = base.withColumn("base", F.lit(True)).unionByName(loose.withColumn("base", F.lit(False)))
    w = Window.partitionBy("rid").orderBy("start", F.col("base").desc(), "end")
    back = Window.partitionBy("rid").orderBy(F.col("start").desc(), "base", F.col("end").desc())  # so that both ways keep a running value
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("clear", ~F.coalesce(ends > F.col("start"), F.lit(False)) & ~F.coalesce(starts < F.col("end"), F.lit(False)))
    return marked.filter(~F.col("base") & F.col("clear")).drop("base", "clear")


def _patterns(spans: DataFrame, shape: Column) -> DataFrame:
    """A row per span and pattern: rid, start, end, instance, kind, pattern, which is null for a span that has none."""
    before, after = F.lower("before"), F.lower("after")
    word = r"[^\x20\x09-\x0D]"
    last = F.regexp_extract(before, rf"({word}+)[\x20\x09-\x0D]*$", 1)
    second = F.regexp_extract(before, rf"({word}+)[\x20\x09-\x0D]+{word}+[\x20\x09-\x0D]*$", 1)
    following = F.regexp_extract(after, rf"^[\x20\x09-\x0D]*({word}+)", 1)
    bare = F.when(shape == "number", F.regexp_replace("match", "[^0-9]", "")).otherwise(F.lower("match"))
    instance = F.concat(shape, F.lit("|"), bare)
    both = (last != "") & (second != "")
    keys = F.array(
        F.when(both, F.concat_ws("|", shape, F.lit("before"), second, last)),
        F.when((last != "") & (following != ""), F.concat_ws("|", shape, F.lit("around"), last, following)),
        F.when(last.rlike("[a-z].*[:=]$"), F.concat_ws("|", shape, F.lit("label"), last)),
    )
    return spans.select("rid", "start", "end", "kind", instance.alias("instance"), F.explode_outer(F.filter(keys, lambda k: k.isNotNull())).alias("pattern"))


def _shape(kind: Column) -> Column:
    return F.when(kind.isin("email", "loose_email"), "email").when(kind == "ip", "ip").otherwise("number")


def _kind(of: str, vote: Column) -> Column:
    """The kind of a pattern or instance, which begins with its shape; votes tell cards from phones."""
    shape = F.substring_index(F.col(of), "|", 1)
    return F.when(shape == "number", F.when(vote > 0, "card").otherwise("phone")).otherwise(shape)


def learn(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern, kind, precision) and instances (instance, score, kind) after the rounds, of which there are at
    least ``rounds``; both written tables."""
    with scratch():
        return _learn(seeds, candidates, rounds)


def _learn(seeds: DataFrame, candidates: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    is_card = F.col("kind") == "card"
    votes = F.max(is_card.cast("int")) - F.max((~is_card).cast("int"))  # of the strict spans, null if there are none
    own = seeds.groupBy("pattern", "instance").agg(F.lit(1.0).alias("seed"), votes.alias("own"))
    edges = own.unionByName(candidates.select("pattern", "instance", F.lit(0.0).alias("seed"), F.lit(None).cast("int").alias("own")))
    edges = stage(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("own").alias("own")), "pii-edges")
    nodes = stage(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.sum("own").alias("own")), "pii-nodes")
    edges = edges.filter(F.col("pattern").isNotNull()).select("pattern", "instance", "own")
    frequent = stage(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT), "pii-contexts")  # no other can ever be backed
    hot = hot_keys(frequent, frequent.agg(F.sum("n")).first()[0] or 0)
    edges = stage(dealt_join(edges, frequent.select("pattern"), ["pattern"], hot), "pii-frequent")
    scores, high, done = nodes.select("instance", F.col("seed").alias("score"), F.col("own").alias("vote")), None, 0
    while True:
        known = F.col("score") >= SCORE
        precise = edges.join(scores, "instance").groupBy("pattern").agg(
            F.avg("score").alias("precision"), F.sum(known.cast("int")).alias("support"),
            F.sum(F.when(known, F.signum(F.coalesce("own", "vote")))).alias("vote"),
        )
        precise = precise.filter((F.col("precision") >= PRECISION) & (F.col("support") >= SUPPORT)).select("pattern", "precision", "vote")
        missed = F.exp(F.sum(F.log1p(-F.least(F.col("precision"), F.lit(0.999)))))
        found = dealt_join(edges.drop("own"), precise, ["pattern"], hot).groupBy("instance").agg((1 - missed).alias("found"), F.max_by(F.when(F.col("vote") > 0, 1).otherwise(-1), F.struct("precision", "vote")).alias("vote"))
        score = F.greatest(F.col("seed"), F.coalesce("found", F.lit(0.0)))
        scores = stage(nodes.join(found, "instance", "left").select("instance", score.alias("score"), F.coalesce("own", "vote").cast("long").alias("vote")), "pii-scores")
        before, high, done = high, scores.filter(known).count(), done + 1
        if done >= rounds and high == before:
            break
    patterns = stage(precise.select("pattern", _kind("pattern", F.col("vote")).alias("kind"), "precision"), "pii-patterns", keep=True)
    scores = stage(scores, "pii-scores", keep=True)
    return patterns, scores.select("instance", "score", _kind("instance", F.col("vote")).alias("kind"))


def find_spans(docs: DataFrame, kinds=KINDS) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id) of the documents, and their spans (rid, kind, start, end, strict)."""
    with scratch():
        return _find_spans(docs, kinds)


def _find_spans(docs: DataFrame, kinds) -> tuple[DataFrame, DataFrame]:
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_matches(k, text) for k in (*kinds, "loose_email", "loose_number")))
    rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", found.alias("found")), "pii-matches", keep=True)
    spans = stage(_spans(rows.select("rid", F.inline("found"))), "pii-spans", keep=True)
    base = spans.filter(F.col("kind").isin(*kinds) & _valid(F.col("kind"), F.col("match")))
    loose = spans.filter(F.col("kind").isin("loose_email", "loose_number")).unionByName(spans.filter((F.col("kind") == "ip") & ~_valid(F.col("kind"), F.col("match"))))
    shape = _shape(F.col("kind"))
    candidates = stage(_patterns(_apart(base, loose), shape), "pii-candidates")
    patterns, scores = learn(_patterns(base, shape), candidates)
    known = scores.filter(F.col("score") >= SCORE).select("instance", F.col("kind").alias("known"))
    total = candidates.count()
    often, common = (hot_keys(candidates.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")), total) for k in ("instance", "pattern"))
    new = dealt_join(dealt_join(candidates.drop("kind"), known, ["instance"], often), patterns, ["pattern"], common, "left")
    here = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("precision", "kind")))
    new = stage(new.groupBy("rid", "start", "end").agg(F.coalesce(here, F.max("known")).alias("kind")), "pii-new", keep=True)
    strict = base.select("rid", "kind", "start", "end", F.lit(True).alias("strict"))
    return rows.select("rid", "doc_id"), strict.unionByName(new.select("rid", "kind", "start", "end", F.lit(False).alias("strict")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"], s["end"])), ",")


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of strict spans by kind, hash of the strict spans, and all spans, of each row."""
    rows, spans = find_spans(docs)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    entry = F.struct("start", order.alias("k"), "end")
    by_row = spans.groupBy("rid").agg(
        *(F.count_if(F.col("strict") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        _joined(F.collect_list(F.when(F.col("strict"), entry))).alias("base"), _joined(F.collect_list(entry)).alias("spans"),
    )
    all_rows = rows.join(by_row, "rid", "left")
    return all_rows.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text cut into blocks of STEP."""
    i, j = F.floor(start / STEP).cast("int"), F.floor(end / STEP).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    first = F.substring(block(i), (start % STEP + 1).cast("int"), F.lit(STEP))
    apart = F.concat(first, F.array_join(F.slice(blocks, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substring(block(j), F.lit(1), (end % STEP).cast("int")))
    return F.when(i == j, F.substring(block(i), (start % STEP + 1).cast("int"), (end - start).cast("int"))).otherwise(apart)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``<kind>``; overlapping spans are replaced as one.

    All columns stay as they are, whatever their names, but for ``text`` and, if there is one, ``n_chars`` of texts that change.
    """
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("doc")), "pii-docs", keep=True)
    ids, spans = find_spans(keyed.select(F.col("rid").alias("doc_id"), F.col("doc.text").alias("text")))
    spans = spans.join(ids, "rid").select(F.col("doc_id").alias("rid"), "kind", "start", "end")
    w = Window.partitionBy("rid").orderBy("start", F.col("end").desc(), "kind")
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.filter(F.col("end") > F.col("reach")).withColumn("start", F.greatest("start", "reach")).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    whole = F.col("doc.text")

    def replaced(blocks: Column) -> Column:
        def pieces(span: Column, i: Column) -> Column:
            at = F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))
            return F.concat(_between(blocks, at, span["start"]), F.lit("<"), span["kind"], F.lit(">"))

        return F.concat(F.array_join(F.transform("spans", pieces), ""), _between(blocks, F.element_at("spans", -1)["end"], F.length(whole)))

    # in blocks, as a substring of a long text is found by walking there
    new = F.when(F.col("spans").isNull(), whole).otherwise(let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{STEP}}}+"), F.lit(0)), replaced))
    kept = lambda name: F.col(f"doc.`{name}`")
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("spans").isNull(), kept("n_chars")).otherwise(F.length("new").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    return keyed.join(spans, "rid", "left").withColumn("new", new).select(*(changed.get(c, kept(c)).alias(c) for c in docs.columns))
