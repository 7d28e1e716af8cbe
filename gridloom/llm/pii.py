"""Personal data: fixed shapes plus bootstrapped contextual extraction, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four expressions, kept if
their digits check out. Beyond them, seed entities induce lexical patterns: a
pattern is a key word with its separator ("password=", 'token = "'), or the one
to three words with their signs to the left or the right of a value ("call",
"passport no"); an instance is the shape of the value there. A value beside words
holds a digit or an @ and at least 3 signs, and may be grouped by blanks. Each side
and number of words has shapes of its own. Spark counts all pattern and
instance pairs of the corpus and scores this graph in rounds: a shape's
confidence starts as the part of its values that are seeds (base entities, and
strings that are keys by their shape); a pattern's confidence is the mean of its
shapes', drawn to zero when its support is small; a shape's becomes the mean of
its patterns'. A value is reported if its pattern and its shape end above the
thresholds, whether or not it was a seed: so new identifiers are found by the
company they keep. Of a text nothing is written but places and shapes: words beside a
value that are values themselves (with a digit or an @) become their shapes, and key
words, values and texts are written as SHA-256 hashes under a secret of the run, which is
never written. Only hashes, shapes and counts are in the graph.

All expressions and joins of spans take time in proportion to the text (or n log
n in its spans), and none recurses, so that any text goes through: runs of a
megabyte of digits, letters or labels are tested.

Defined cases: a null text is empty; a text without spans has empty spans and
the checksum of the empty string; repeated rows get each their own result; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, read
from gridloom.llm.spans import blocks, bound, cut, quoted, running, spans

#: The base kinds in their order, and their expressions.
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: The same matches without a way back: groups repeat possessively, and a match starts where a run of its characters does or a match ended.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE[3][1],
}
#: Kinds that the method adds: keys by their shape, values by their context.
KEY, SECRET = "key", "secret"
KEY_SHAPE = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
PAIR = r"""([A-Za-z][A-Za-z_-]{1,29})(\s?[=:]\s?["']?)([A-Za-z0-9+/_=.@-]{6,})"""
#: A value beside words: a phone number, groups with a digit apart by one blank, or signs with a digit or an @ among their first 64.
VALUE = (
    r"(?<![A-Za-z0-9])(?:\+[0-9][\x20().0-9-]+[0-9](?![A-Za-z0-9])|(?=[A-Z]{0,5}[0-9])[A-Z0-9]{2,6}(?:\x20(?=[A-Z]{0,5}[0-9])[A-Z0-9]{2,6}(?![A-Za-z0-9]))++"
    r"|(?=[A-Za-z+/_.%-]{0,63}[0-9@])[A-Za-z0-9][A-Za-z0-9+/_.@%-]+[A-Za-z0-9])"
)
#: Words of a context at most, and the characters that they are looked for in.
WORDS, WINDOW = 3, 64
#: A value that is a seed though it is of no base kind: long hexadecimal strings and keys.
SEED = r"^((?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|AKIA[0-9A-Z]{16})$"
ROUNDS = 4
#: Bytes of the added spans that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Weight of the doubt against a pattern or shape, in occurrences.
DOUBT = 2.0
PATTERN_LEAST = 0.6
SHAPE_LEAST = 0.5
#: Different values that a pattern must have been seen with, at least.
SUPPORT = 3


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = _digits(x)
    step = f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr({d}, length({d}) - i + 1, 1)) ELSE int(substr('0246813579', int(substr({d}, length({d}) - i + 1, 1)) + 1, 1)) END)"
    return f"length({d}) BETWEEN 12 AND 19 AND {step} % 10 = 0"


#: What the found string x must satisfy.
CHECKS = {
    "email": None,
    "ip": "forall(split(x.found, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
    "card": _luhn("x.found"),
    "phone": f"length({_digits('x.found')}) BETWEEN 9 AND 15",
}
_NONE = "cast(array() as array<struct<low:int,rank:int,high:int>>)"


def _kind(rank: int, regex: str, check: str | None, gate: str) -> str:
    """Array of (low, rank, high) of a kind's spans."""
    found = spans("t", quoted(regex))
    if check:
        found = f"filter({found}, x -> {check})"
    return f"CASE WHEN {gate} THEN transform({found}, x -> struct(x.low AS low, {rank} AS rank, x.high AS high)) ELSE {_NONE} END"


def with_base(docs: DataFrame) -> DataFrame:
    """t (the text) and the arrays email, ip, card, phone and keys beside the columns named keep_*."""
    t = docs.withColumn("digits", F.col("t").rlike("[0-9]"))
    gates = {"email": "contains(t, '@')", "ip": "digits AND contains(t, '.')", "card": "digits", "phone": "digits AND contains(t, '+')"}
    columns = {kind: F.expr(_kind(i, FAST[kind], CHECKS[kind], gates[kind])) for i, (kind, _) in enumerate(BASE)}
    columns["keys"] = F.expr(_kind(4, KEY_SHAPE, None, "contains(t, 'AKIA')"))
    return t.withColumns(columns).drop("digits")


def pairs(docs: DataFrame) -> DataFrame:
    """One row per key and value: text_key, key, separator, value, low, high."""
    has = docs.where("contains(t, '=') OR contains(t, ':')")
    found = has.select("text_key", F.explode(F.expr(spans("t", quoted(PAIR)))).alias("x")).select("text_key", "x.*")
    part = lambda k: F.regexp_extract("found", PAIR, k)
    found = found.select("text_key", "low", "high", F.lower(part(1)).alias("key"), F.regexp_replace(part(2), r"\s", "").alias("separator"), part(3).alias("value"))
    return found.withColumn("low", F.col("high") - F.length("value"))


def contexts(docs: DataFrame) -> DataFrame:
    """One row per value, side and number of words beside it, as of pairs(); separator is the side and the number."""
    found = docs.where("text_key IS NOT NULL AND (t RLIKE '[0-9]' OR contains(t, '@'))").select("text_key", F.explode(F.expr(spans("t", quoted(VALUE), around=WINDOW))).alias("x"))
    words = lambda x: f"split(regexp_replace(lower({x}), '[0-9]+', '9'), '[\\\\x20\\\\x09-\\\\x0D]+')"
    clean = lambda x: f"transform({words(x)}, w -> IF(w RLIKE '[9@]', left(regexp_replace(w, '[^9@.:-]+', 'a'), 8), w))"
    found = found.select("text_key", F.col("x.low").alias("low"), F.col("x.high").alias("high"), F.col("x.found").alias("value"), F.expr(clean("x.left")).alias("l"), F.expr(clean("x.right")).alias("r"))
    found = found.withColumns({"l": F.expr("IF(element_at(l, -1) = '', slice(l, 1, size(l) - 1), l)"), "r": F.expr("IF(r[0] = '', slice(r, 2, size(r)), r)")})
    sides = [f"named_struct('key', IF(size({c}) >= {n}, array_join(slice({c}, {-n if c == 'l' else 1}, {n}), ' '), ''), 'separator', '{side}{n}')" for c, side in (("l", "<"), ("r", ">")) for n in range(1, WORDS + 1)]
    found = found.withColumns({"shape": shape(F.col("value")), "seed": seeds(F.col("value")) | phone(F.col("value"))})
    found = found.select("text_key", "low", "high", "value", "shape", "seed", F.explode(F.expr(f"filter(array({', '.join(sides)}), c -> c.key <> '')")).alias("c"))
    return found.select("text_key", "low", "high", "c.key", "c.separator", "value", F.concat("c.separator", "shape").alias("shape"), "seed")


def hidden(text, secret: str):
    """A hash of a text that tells nothing without the secret."""
    return F.substring(F.sha2(F.concat(F.lit(secret), text).cast("binary"), 256), 1, 32)


def shape(value):
    """Letters and digits by class, runs shortened: the value's form without its content."""
    s = F.when(value.rlike(r"^[0-9a-f]+$") & value.rlike("[0-9]") & value.rlike("[a-f]"), F.lit("hex"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    mixed = F.when(F.length(plain) > 6, F.concat(F.substring(plain, 1, 6), F.lit("~"))).otherwise(plain)
    return F.coalesce(s, mixed)


def seeds(value):
    """Whether a value is an entity of a base kind or a key by its shape."""
    whole = lambda r: value.rlike("^(?:" + r + ")$")
    return value.rlike(SEED) | whole(FAST["email"]) | whole(FAST["ip"]) | F.expr("value RLIKE '^[0-9][0-9-]+$' AND " + _luhn("value"))


def phone(value):
    return value.rlike("^" + BASE[3][1] + "$") & F.expr(f"length({_digits('value')}) BETWEEN 9 AND 15")


def confident_patterns(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, separator, shape) above both thresholds, from the graph (key, separator, shape, n, seeds, values)."""
    prior = graph.groupBy("shape").agg((F.sum("seeds") / F.sum("n")).alias("prior"))
    shapes = prior.select("shape", "prior", F.col("prior").alias("confidence"))
    for _ in range(rounds):
        named = shapes.select(F.col("shape").alias("s_shape"), "confidence")
        patterns = graph.join(named, F.col("shape") == F.col("s_shape")).groupBy("key", "separator").agg(
            (F.sum(F.col("n") * F.col("confidence")) / (F.sum("n") + DOUBT)).alias("strength"), F.sum("values").alias("support"))
        named = patterns.select(F.col("key").alias("p_key"), F.col("separator").alias("p_separator"), "strength")
        on = (F.col("key") == F.col("p_key")) & (F.col("separator") == F.col("p_separator"))
        raised = graph.join(named, on).groupBy("shape").agg((F.sum(F.col("n") * F.col("strength")) / (F.sum("n") + DOUBT)).alias("raised"))
        raised = raised.withColumnRenamed("shape", "r_shape")
        shapes = prior.join(raised, F.col("shape") == F.col("r_shape")).select("shape", "prior", F.greatest("prior", "raised").alias("confidence"))
    good = patterns.where((F.col("strength") >= PATTERN_LEAST) & (F.col("support") >= SUPPORT)).select(F.col("key").alias("p_key"), F.col("separator").alias("p_separator"))
    fine = shapes.where(F.col("confidence") >= SHAPE_LEAST).select(F.col("shape").alias("s_shape"))
    on = (F.col("key") == F.col("p_key")) & (F.col("separator") == F.col("p_separator"))
    return graph.join(good, on, "left_semi").join(fine, F.col("shape") == F.col("s_shape"), "left_semi").select("key", "separator", "shape")


def find(spark: SparkSession, docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row (as keep_0, ...), t, email, ip, card, phone (base spans), base and all (arrays of low, rank, high)."""
    stage, secret = Stage(spark, "pii"), uuid.uuid4().hex
    t = docs.select(*[docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)], F.coalesce(docs["text"], F.lit("")).alias("t"))
    keyed = t.withColumn("text_key", F.when(F.expr("contains(t, '=') OR contains(t, ':') OR contains(t, '@') OR t RLIKE '[0-9]'"), hidden(F.col("t"), secret)))
    found = pairs(keyed.select("t", "text_key")).withColumns({"shape": shape(F.col("value")), "seed": seeds(F.col("value"))})
    found = found.unionByName(contexts(keyed.select("t", "text_key"))).withColumns({"value": hidden(F.col("value"), secret), "key": hidden(F.col("key"), secret)})
    found = stage.write(found)
    each = found.groupBy("key", "separator", "shape", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds"))
    graph = stage.write(each.groupBy("key", "separator", "shape").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"), F.count(F.lit(1)).alias("values")))
    best = confident_patterns(graph).select(F.col("key").alias("b_key"), F.col("separator").alias("b_separator"), F.col("shape").alias("b_shape"))
    on = (F.col("key") == F.col("b_key")) & (F.col("separator") == F.col("b_separator")) & (F.col("shape") == F.col("b_shape"))
    told = found.join(best, on, "left_semi")
    added = told.groupBy("text_key").agg(F.collect_set(F.struct("low", F.lit(5).alias("rank"), "high")).alias("added")).withColumnRenamed("text_key", "a_key")
    added = stage.write(added)
    stage.keep(added)
    size = added.agg(F.sum(12 * F.size("added") + 60)).first()[0] or 0
    out, own = with_base(keyed), F.col("text_key")
    if size <= BROADCAST_BYTES:
        added = F.broadcast(added)
    else:  # rows without pairs get a key of their own, so that they are dealt out evenly
        own = F.coalesce("text_key", F.concat(F.lit("~"), F.xxhash64("t", "keep_0").cast("string")))
    out = out.withColumn("text_key", own).join(added, F.col("text_key") == F.col("a_key"), "left").drop("a_key", "text_key")
    out = out.withColumn("base", F.expr("array_sort(concat(email, ip, card, phone))"))
    # sorted by start, base spans first: a new one stays unless a base span that starts before it ends behind it
    ranked = "array_sort(concat(transform(base, x -> struct(x.low AS low, 0 AS new, x.rank AS rank, x.high AS high)), transform(concat(keys, coalesce(added, " + _NONE + ")), x -> struct(x.low AS low, 1 AS new, x.rank AS rank, x.high AS high))))"
    ends = bound("transform(s, x -> IF(x.new = 0, x.high, -1))", "h", running("h", "greatest({x}, {y})"))
    kept = "filter(s, (x, i) -> x.new = 0 OR e[i] < x.high AND (i = 0 OR x <> s[i - 1]))"
    both = bound(ranked, "s", bound(ends, "e", f"transform({kept}, x -> struct(x.low AS low, x.rank AS rank, x.high AS high))"))
    out = out.withColumn("all", F.expr(f"CASE WHEN size(keys) > 0 OR added IS NOT NULL THEN array_sort({both}) ELSE base END"))
    return out.drop("keys", "added")


def _joined(array: str) -> str:
    kinds = ", ".join(quoted(k) for k in [*(k for k, _ in BASE), KEY, SECRET])
    return f"array_join(transform({array}, x -> concat(element_at(array({kinds}), x.rank + 1), ':', x.low, ':', x.high)), ',')"


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans."""
    out = find(spark, docs, ["doc_id"])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, _ in BASE]
    return out.select(F.col("keep_0").alias("doc_id"), *counts, F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), F.expr(_joined("all")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    names = docs.columns
    marked = docs.withColumn("text_was_null", docs["text"].isNull())
    out = find(spark, marked, [*names, "text_was_null"])
    kinds = ", ".join(quoted(f"[{k}]") for k in [*(k for k, _ in BASE), KEY, SECRET])
    # e[i]: the furthest end of the spans up to i; a span that starts before it belongs to an earlier one
    gap = cut("c", "CASE WHEN i > 0 THEN e[i - 1] ELSE 0 END", "x.low")
    parts = f"transform(all, (x, i) -> CASE WHEN i = 0 OR x.low >= e[i - 1] THEN concat({gap}, element_at(array({kinds}), x.rank + 1)) ELSE '' END)"
    rest = cut("c", "element_at(e, -1)", "length(t)")
    ends = bound("transform(all, x -> x.high)", "h", running("h", "greatest({x}, {y})"))
    clean = bound(blocks("t"), "c", bound(ends, "e", f"concat(array_join({parts}, ''), {rest})"))
    text = F.when(F.col(f"keep_{len(names)}"), F.lit(None).cast("string")).when(F.size("all") > 0, F.expr(clean)).otherwise(F.col("t"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"keep_{i}").alias(c) for i, c in enumerate(names)])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, read(spark, sf_dir, "documents"))
