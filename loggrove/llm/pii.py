"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts. Only DataFrame and SQL functions.

Base kinds (email, ip, card, phone) are found by pattern. They seed a graph: an instance is a token that looks like an
identifier (an @, or four digits or more; blanks, colons and equals signs part tokens, so a label may stand right before one),
a pattern is one of its contexts: the word before it, the two or the three words before it, or the word after it, in lower
case, without signs, digits as zeros. A pattern's confidence is the confidence of its instances, weighted by occurrence, over
all occurrences of its words in the corpus (identifiers not known to be personal count half against it); an instance's is that
of at least one of its patterns being right (seeds: 1). After some rounds, identifiers behind confident patterns are found too.

A pattern whose occurrences mostly precede no identifier can't become confident whatever its instances are, so it leaves
the graph at once: common words never reach a join, and what is frequent all the same (a label that a third of all rows hold)
is spread. Matches are placed by the lengths of the pieces between them. Each document's row is frozen with a row number in
the shared folder, so repeated ids stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds. A match starts where a run of its characters does, or at the end of the one before; runs
#: that nothing could shorten are possessive; digits that are too few for a card are passed over. None of it changes what is
#: found, all of it keeps long runs from being tried again and again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))(?=[0-9](?:[\x20-]?[0-9]){11})[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
TOKEN = r"(?<![^\s:=])(?=[^\s:=@]*+@|(?:[^\s:=0-9]*+[0-9]){4})[^\s:=]++"
#: Rounds of scoring, confidence from which a pattern and an instance count, distinct instances that a pattern needs, and what is added to its occurrences.
ROUNDS, CONFIDENT, SUPPORT, PRIOR = 3, 0.5, 5, 2.0
#: Share of an identifier of unknown kind that counts against its pattern (an occurrence before no identifier counts wholly).
UNKNOWN = 0.5
DIGITS = 4
#: Matches of a text that are placed together.
SLICE = 256
#: What parts words, and characters of the text on each side of a token that its context is taken from.
PART = r"[\s:=]"
CONTEXT_CHARS = 200
#: Patterns up to which their words are counted by a broadcast filter (8 bytes each); beyond it all word groups are counted.
FEW_PATTERNS = 500_000


def placed(text: Column, pattern: str, may: Column, left=None, right=None) -> Column:
    """Array of (m, start, l, r) for the matches of pattern, start in characters. may: cheap condition.

    l and r: what functions left and right make of the text between the match and the one before it, or the one after.
    """
    found = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    none = lambda g: F.lit("")
    around = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), (left or none)(g).alias("l"), (right or none)(g).alias("r")))
    both = _let(around, lambda a: F.zip_with(a, F.when(F.size(a) > 0, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a), lambda x, y: F.struct(x["n"].alias("n"), x["l"].alias("l"), y["r"].alias("r"))))
    pairs = F.filter(F.zip_with(found, both, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int,l:string,r:string>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"]["n"] + F.length(x["m"])).cast("int").alias("at"),
        F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), (acc["at"] + x["g"]["n"]).cast("int").alias("start"), x["g"]["l"].alias("l"), x["g"]["r"].alias("r")))).alias("out"),
    )
    # sums within slices of SLICE matches, then over the slices: growing one array by one would copy it as often as it has matches
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    after = lambda acc, x: F.struct((acc["at"] + x["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    slices = _let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(p), F.lit(SLICE)).cast("int")), lambda k: F.aggregate(F.slice(p, k * SLICE + 1, SLICE), start, step)))
    moved = lambda x, o: F.transform(x["out"], lambda t: F.struct(t["m"].alias("m"), (t["start"] + o).cast("int").alias("start"), t["l"].alias("l"), t["r"].alias("r")))
    return _let(slices, lambda s: F.flatten(F.zip_with(s, F.aggregate(s, first, after, lambda acc: acc["out"]), moved)))


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once: inside a function of an array, a column's expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_VALID)
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (start, end) of each base kind."""
    has_digit = text.rlike("[0-9]")
    may = {"email": F.instr(text, "@") > 0, "ip": has_digit & (F.instr(text, ".") > 0), "card": has_digit, "phone": F.instr(text, "+") > 0}
    out = {}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        good = F.filter(placed(text, pattern, may[kind]), _checked(kind))
        out[kind] = F.transform(good, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).cast("int").alias("end")))
    return out


def _checked(kind: str):
    return lambda x: valid(kind, x["m"])


def plain(text: Column) -> Column:
    """Text whose words are normal: lower case, no signs, digits as zeros."""
    return F.translate(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s:=]+", "")), "123456789", "0" * 9)


def tokens(text: Column) -> Column:
    """Array of (m, start, l, r): tokens that look like identifiers, with up to three words before (since the last such token) and the one after."""
    before = lambda g: F.regexp_extract(plain(F.substring(g, -CONTEXT_CHARS, CONTEXT_CHARS)), rf"(?<![^\s:=])((?:[^\s:=]++{PART}++){{0,2}}[^\s:=]++){PART}*+$", 1)
    after = lambda g: F.regexp_extract(plain(F.substring(g, 1, CONTEXT_CHARS)), rf"^{PART}*+([^\s:=]++)", 1)
    return placed(text, TOKEN, text.rlike("@|[0-9]"), before, after)


def gram(*words: Column) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def contexts(l: Column, r: Column) -> Column:  # noqa: E741
    """Array of (p, t): patterns of a token by its contexts, and the words whose occurrences they are measured against."""

    def of(words: Column) -> Column:
        word = lambda k: F.element_at(words, -k)
        named = word(1).rlike(r"^\p{L}")
        each = [F.when(named & (F.size(words) >= k), F.struct(*[gram(*[word(j) for j in range(k, 0, -1)]).alias(c) for c in ("p", "t")])) for k in (1, 2, 3)]
        each.append(F.when(r.rlike(r"^\p{L}"), F.struct(F.xxhash64(F.lit("after"), r).alias("p"), gram(r).alias("t"))))
        return F.array_compact(F.array(*each))

    return _let(F.split(l, rf"{PART}+"), of)


def candidates(tokens_: Column, base: Column) -> Column:
    """Array of (inst, start, end, seed, contexts) from tokens without what surrounds them; seed: a base span overlaps. Both are stored columns."""
    trimmed = F.transform(tokens_, lambda t: F.struct(
        F.regexp_replace(t["m"], "^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$", "").alias("inst"),
        (t["start"] + F.length(t["m"]) - F.length(F.regexp_replace(t["m"], "^[^A-Za-z0-9+@]+", ""))).cast("int").alias("start"),
        contexts(t["l"], t["r"]).alias("contexts"),
    ))
    like = F.filter(trimmed, lambda t: (F.size(t["contexts"]) > 0) & ((F.instr(t["inst"], "@") > 0) | (F.length(_digits(t["inst"])) >= DIGITS)))
    return F.transform(like, lambda t: F.struct(
        F.lower(t["inst"]).alias("inst"), t["start"].alias("start"), (t["start"] + F.length(t["inst"])).cast("int").alias("end"),
        F.exists(base, lambda b: (b["start"] < t["start"] + F.length(t["inst"])) & (t["start"] < b["end"])).alias("seed"), t["contexts"].alias("contexts"),
    ))


def totals(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, total): how often the words of each t of wanted (a stored table) follow each other in all texts.

    A few wanted ones are broadcast and filter the word groups where they arise; else all groups are counted, by task first,
    and joined after that. Both ways give the same counts.
    """
    words = texts.select(F.split(plain(F.col("text")), rf"{PART}+").alias("w"))
    shifted = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.concat(F.array(F.lit("")), "w").alias("b"), F.concat(F.array(F.lit(""), F.lit("")), "w").alias("c"))).alias("z"))
    z = shifted.select("z.*").toDF("a", "b", "c").where("a is not null and a <> ''")
    grams = z.select(F.explode(F.array(gram(F.col("a")), gram(F.col("b"), F.col("a")), gram(F.col("c"), F.col("b"), F.col("a")))).alias("t"))
    wanted = wanted.select("t").distinct()
    if wanted.count() <= FEW_PATTERNS:
        return grams.join(F.broadcast(wanted), "t", "left_semi").groupBy("t").agg(F.count("*").alias("total"))
    return grams.groupBy("t").agg(F.count("*").alias("total")).join(wanted.hint("shuffle_hash"), "t", "left_semi")


def patterns(cands: DataFrame, texts: DataFrame, name: str = "pii") -> tuple[DataFrame, DataFrame]:
    """Confident patterns (p, n) and instances (inst, n) from cands (p, t, inst, seed) and all texts (text); n: their occurrences."""
    seen = cands.groupBy("p", "inst").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.any_value("t").alias("t"))
    edges = common.stored(seen, f"{name}-edges")
    perhaps = edges.groupBy("p").agg(F.any_value("t").alias("t"), F.sum("n").alias("occurs"), F.count("*").alias("n"), F.max("seed").alias("seed"))
    # a pattern without any seed can rise only by instances of other patterns, so it stays; one with few instances doesn't
    perhaps = common.stored(perhaps.where(F.col("n") >= SUPPORT), f"{name}-perhaps")
    counted = common.stored(totals(texts, perhaps), f"{name}-totals")
    # confidence if all instances were right; below CONFIDENT nothing can save it
    out_of = F.greatest("total", "occurs") + PRIOR
    viable = perhaps.join(counted, "t").where(F.col("occurs") / out_of >= CONFIDENT).select("p", out_of.alias("out_of"), F.col("n").alias("m"), "occurs")
    viable = common.stored(viable, f"{name}-viable")
    edges = common.stored(common.join_spread(edges.drop("t"), viable, "p", "m"), f"{name}-graph")
    # confidence of an instance (n: its rows in the graph, for the joins)
    confidence = common.stored(edges.groupBy("inst").agg(F.max("seed").cast("double").alias("c"), F.count("*").alias("m2"), F.sum("n").alias("occurs2")), f"{name}-instances")
    for k in range(ROUNDS):
        both = common.join_spread(edges, confidence, "inst", "m2")
        scored = both.groupBy("p").agg((F.sum(F.col("n") * F.col("c")) / (F.max("out_of") - (1 - UNKNOWN) * F.sum(F.col("n") * (1 - F.col("c"))))).alias("score"), F.sum((F.col("c") >= CONFIDENT).cast("long")).alias("support"), F.max("m").alias("m3"), F.max("occurs").alias("occurs3"))
        good = common.stored(scored.where((F.col("score") >= CONFIDENT) & (F.col("support") >= SUPPORT)), f"{name}-patterns-{k}")
        miss = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("score", F.lit(0.0))))))
        found = common.join_spread(edges, good, "p", "m3", "left").groupBy("inst").agg(F.greatest(F.max("seed").cast("double"), 1 - miss).alias("c"), F.count("*").alias("m2"), F.sum("n").alias("occurs2"))
        confidence = common.stored(found, f"{name}-instances-{k}")
    return good.select("p", F.col("occurs3").alias("n")), confidence.where(F.col("c") >= CONFIDENT).select("inst", F.col("occurs2").alias("n"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found) of every row: arrays of (start, kind order, end, kind) sorted by start, then kind; found has base and context spans.

    Offsets are in characters, end exclusive. Null and empty texts have none; repeated rows stay, each with the same result.
    A very long text costs time in proportion to its length; extra columns aren't read, so their names can't clash; an empty
    table gives an empty one.
    """
    texts = common.as_texts(docs, id_col, text_col)
    spans = base_spans(F.col("text"))
    as_row = lambda k, n: F.transform(F.col(n), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(n).alias("kind")))
    found = texts.select("doc_id", "text", *[c.alias(k) for k, c in spans.items()])
    found = found.select("doc_id", "text", F.array_sort(F.concat(*[as_row(k, n) for k, n in enumerate(KINDS)])).alias("base"))
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", tokens(F.col("text")).alias("tokens"))
    rows = common.stored(found, "pii-rows")
    cands = common.stored(rows.select("row", F.explode(candidates(F.col("tokens"), F.col("base"))).alias("c")).select("row", "c.*"), "pii-candidates")
    each = cands.select("row", "inst", "start", "end", "seed", F.explode("contexts").alias("x")).select("row", "inst", "start", "end", "seed", "x.p", "x.t")
    good, sure = patterns(each.select("p", "t", "inst", "seed"), texts)
    new = common.join_spread(each.where("not seed").select("row", "inst", "start", "end", "p"), common.stored(good, "pii-good"), "p").drop("n")
    new = common.join_spread(common.stored(new, "pii-behind-good"), common.stored(sure, "pii-sure"), "inst").select("row", "start", "end").distinct()
    more = new.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("k"), "end", F.lit("context").alias("kind"))).alias("more"))
    out = rows.select("row", "doc_id", "base").join(more, "row", "left")
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("found"))


def digests(docs: DataFrame, **options) -> DataFrame:
    found = extract(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"))
