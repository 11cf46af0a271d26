"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find seeds (e-mail and IP addresses, card and phone numbers), and so does the shape of keys (long hexadecimal or mixed strings),
which count only where a confident pattern has them. The words around digit-bearing tokens are lexical patterns;
a graph of patterns and instances, aggregated over all documents, is scored in rounds: a pattern by the confidence of its instances,
an instance by its patterns. Identifiers that a round finds support patterns in the next one, until a round adds nothing. High-confidence
patterns then find identifiers that no base pattern has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, drop_materialised, materialise

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and look-behinds give the matches of the plain patterns in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?:\G|(?<![A-Za-z0-9@._%+-]))[A-Za-z@._%+-]*+[0-9][A-Za-z0-9@._%+-]*+"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Seeds that are no base kind: 32 hexadecimal digits or more, or 20 letters and digits or more of both cases, with letters and digits.
KEY = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z0-9+/_-]{20,}+=*+)$"
#: The word before a token, with the sign that assigns it, read backwards; the word after it.
LEFT = r"^[\s\"'(<\[]*+([=:]*+\s*+[^\s\"'(<\[]++)"
RIGHT = r"^[\s\"')>\],.;:]*+([^\s\"')>\],.;:]++)"
#: A token counts with so many characters and digits at least.
TOKEN_CHARS, TOKEN_DIGITS = 6, 4
#: Different confident instances that a pattern needs, its share of confident instances, and the confidence of what it finds.
SUPPORT, PRECISION, CONFIDENCE = 3, 0.8, 0.9
#: Texts with spans are broadcast up to this number when they are cut.
BROADCAST_ROWS = 200_000
SPAN = "array<struct<s:int,e:int,v:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, v), in code points, e exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    start = F.expr(f"named_struct('p', 0, 'o', cast(array() as {SPAN}))")

    def step(acc: Column, x: Column) -> Column:
        at = acc["p"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("p"), F.concat(acc["o"], F.array(F.struct(at.alias("s"), end.alias("e"), x["hit"].alias("v")))).alias("o")))

    return F.aggregate(both, start, step, lambda a: a["o"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + acc["odd"])
        return F.struct((F.lit(1) - acc["odd"]).alias("odd"), (acc["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"))

    total = F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), F.struct(F.lit(0).alias("odd"), F.lit(0).alias("sum")), step, lambda a: a["sum"])
    return total % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind; a match that fails its check is dropped and not tried again."""
    def valid(x: Column) -> Column:
        if kind == "ip":
            return x["v"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
        digits = F.regexp_replace(x["v"], "[^0-9]", "")
        if kind == "card":
            return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
        return F.length(digits).between(8, 15)

    found = matches(text, PATTERNS[kind])
    found = found if kind == "email" else F.filter(found, valid)
    some = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")
    return F.when(some, found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def tokens(text: Column) -> Column:
    """Digit-bearing tokens with the words before and after: array of (s, e, v, left, right)."""
    gaps = F.split(text, TOKEN, -1)
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    both = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    kind = "array<struct<s:int,e:int,v:string,left:string,right:string>>"
    start = F.expr(f"named_struct('p', 0, 'o', cast(array() as {kind}))")

    def step(acc: Column, x: Column) -> Column:
        at = acc["p"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        left = F.lower(F.reverse(F.regexp_extract(F.reverse(x["gap"]), LEFT, 1)))
        right = F.lower(F.regexp_extract(F.coalesce(x["next"], F.lit("")), RIGHT, 1))
        row = F.struct(at.alias("s"), end.alias("e"), x["hit"].alias("v"), left.alias("left"), right.alias("right"))
        counts = (F.length(x["hit"]) >= TOKEN_CHARS) & (F.length(F.regexp_replace(x["hit"], "[^0-9]", "")) >= TOKEN_DIGITS)
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("p"), F.when(counts, F.concat(acc["o"], F.array(row))).otherwise(acc["o"]).alias("o")))

    return F.when(text.rlike("[0-9]"), F.aggregate(both, start, step, lambda a: a["o"])).otherwise(F.expr(f"cast(array() as {kind})"))


def found_in(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, base kinds, tokens) for each row: base spans and tokens of the whole text; h is a hash of the text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("k"), t.alias("t"), F.xxhash64(t).alias("h"))
    rows = rows.select("k", "h", *[base_spans(F.col("t"), kind).alias(kind) for kind in KINDS], tokens(F.col("t")).alias("tokens"))
    bare = [F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(kind) for kind in KINDS]
    return rows.select("k", "h", *bare, "tokens")


def occurrences(found: DataFrame) -> DataFrame:
    """(k, h, s, e, v, base, seed, patterns): a row for each token, whether a base span overlaps it, whether it is a seed, and its patterns."""
    spans = F.concat(*[F.col(kind) for kind in KINDS])
    rows = found.filter(F.size("tokens") > 0).select("k", "h", spans.alias("spans"), F.explode("tokens").alias("x")).select("k", "h", "spans", "x.*")
    base = F.exists("spans", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"]))
    seed = base | F.col("v").rlike(KEY)
    slot = F.when(F.contains("v", F.lit("@")), "@").when(~F.col("v").rlike("[A-Za-z]"), "9").otherwise("x")
    pattern = lambda side, *words: F.xxhash64(F.lit(side), slot, *words)
    left, right = F.col("left") != "", F.col("right") != ""
    patterns = F.array_compact(F.array(F.when(left, pattern("L", "left")), F.when(right, pattern("R", "right")), F.when(left & right, pattern("B", "left", "right"))))
    return rows.select("k", "h", "s", "e", F.xxhash64("v").alias("v"), base.alias("base"), seed.cast("int").alias("seed"), patterns.alias("patterns"))


def scored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (p) and confident instances (v) of the graph (p, v, seed).

    What a round has found stays, so the rounds add to it and come to an end: the first one that adds neither a pattern nor an instance.
    """
    sure = edges.select("p", "v", F.col("seed").cast("double").alias("c"), F.col("seed").cast("int").alias("known"))
    good = inst = None
    size = None
    while True:
        # A seed is certain, an instance of an earlier round is known; only these support a pattern.
        found = sure.groupBy("p").agg(F.avg("c").alias("precision"), F.sum("known").alias("support")).filter((F.col("support") >= SUPPORT) & (F.col("precision") >= PRECISION))
        if good is not None:
            found = found.select("p", "precision").unionByName(good).groupBy("p").agg(F.max("precision").alias("precision"))
        new_good = materialise(found.select("p", "precision"), "patterns")
        odds = edges.join(new_good, "p").groupBy("v").agg(F.max("seed").alias("is_seed"), F.sum(F.log(1 - 0.999 * F.col("precision"))).alias("doubt"))
        new_inst = materialise(odds.select("v", F.when(F.col("is_seed") == 1, 1.0).otherwise(1 - F.exp("doubt")).alias("c")), "instances")
        for old in (good, inst):
            if old is not None:
                drop_materialised(old)
        good, inst = new_good, new_inst
        now = (good.count(), inst.filter(F.col("c") >= CONFIDENCE).count())
        if now == size:
            return good.select("p"), inst.filter(F.col("c") >= CONFIDENCE).select("v")
        size = now
        c = F.coalesce("c", F.col("seed").cast("double"))
        sure = edges.join(inst, "v", "left").select("p", "v", c.alias("c"), F.greatest("seed", (c >= CONFIDENCE).cast("int")).alias("known"))


def discovered(found: DataFrame) -> DataFrame:
    """(k, h, context): the spans that confident patterns find beside the base ones."""
    seen = occurrences(found)
    edges = materialise(seen.select("v", "seed", F.explode("patterns").alias("p")).groupBy("p", "v").agg(F.max("seed").alias("seed")), "edges")
    good, sure = scored(edges)
    new = seen.filter("not base").join(sure, "v", "left_semi").select("k", "h", "s", "e", F.explode("patterns").alias("p")).join(good, "p", "left_semi")
    return new.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("context"))


def extract(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, email, ip, card, phone, context): arrays of spans (s, e) for each row of ``df``; h is ``xxhash64`` of its text.

    A null text is an empty one; rows with equal key and text have equal spans, null keys too. An empty table gives no rows.
    """
    found = materialise(found_in(df, key, text), "found")
    new = discovered(found).withColumnsRenamed({"k": "__xylem_k", "h": "__xylem_h"})
    joined = found.drop("tokens").join(new, (F.col("h") == F.col("__xylem_h")) & F.col("k").eqNullSafe(F.col("__xylem_k")), "left")
    return joined.select("k", "h", *KINDS, F.coalesce("context", F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias("context"))


def joined_spans(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    def shown(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*[shown(kind) for kind in kinds]), ",")


def digest(spans: DataFrame) -> DataFrame:
    """The columns of the query from the rows of :func:`extract`."""
    return spans.select(
        F.col("k").alias("doc_id"), *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined_spans(KINDS), 256).alias("base_sha256"), joined_spans((*KINDS, "context")).alias("spans"),
        F.size("context").cast("long").alias("n_context"), sum(F.size(kind) for kind in (*KINDS, "context")).cast("long").alias("n_spans"),
    )


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with each span of its texts replaced by the kind in angle brackets; other rows and columns stay as they are.

    Overlapping spans are replaced as one, named after the first. Nulls stay null.
    """
    spans = extract(df, key, text)
    label = lambda kind: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("l")))
    spans = spans.select(F.col("k").alias("__xylem_k"), F.col("h").alias("__xylem_h"), F.array_sort(F.concat(*[label(k) for k in (*KINDS, "context")])).alias("__xylem_spans")).filter(F.size("__xylem_spans") > 0).distinct()
    spans = broadcast_if_small(materialise(spans, "spans"), BROADCAST_ROWS)
    t = F.col(text).cast("string")

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["o"], F.substring(t, acc["p"] + 1, F.greatest(x["s"] - acc["p"], F.lit(0))), F.when(x["s"] >= acc["p"], x["l"]).otherwise(""))
        return F.when(x["e"] <= acc["p"], acc).otherwise(F.struct(x["e"].alias("p"), more.alias("o")))

    cut = F.aggregate("__xylem_spans", F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), step, lambda a: F.concat(a["o"], F.substring(t, a["p"] + 1, F.lit(2**31 - 1))))
    both = df.join(spans, (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col("__xylem_h")) & F.col(key).cast("long").eqNullSafe(F.col("__xylem_k")), "left")
    return both.withColumn(text, F.when(F.col("__xylem_spans").isNull(), t).otherwise(cut)).select(df.columns)
