"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is the row of its words. Two lines are near if one turns into the other by at most one edit: a word put in,
taken out or replaced. Every line emits the hash of each variant with one word deleted: lines of equal length that
share a variant at the same place differ by a replaced word; a line that equals a variant of a longer one differs by a
deletion. So the variants' groups are joined by their smallest line, without ever listing pairs: what is looked for is
whether an earlier line exists. The edit distance between a line and each earlier one found is verified before the line goes.

Equal lines are one class first, by 128 bits of hash. As one edit leaves the first or the last half of a line as it
was, only classes that share a half with another class emit variants; no near pair is lost by that. What is looked for
in all lines or texts (halves, first lines, variants, documents) is told from the rest by sieves of bits where it is
read, so that only what is found moves: texts move only where lines are taken out of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Sieve, Workspace, read

#: Lines of fewer words are headings, list items and the like: they have no near lines, only equal ones.
MIN_WORDS = 5
#: Words of a line that a running value is worked out for at a time.
BLOCK = 16
HALVES = ["a1", "z1", "a2", "z2"]


def _plain(text: Column) -> Column:
    """Lower-cased, with a space for every ASCII white space but the line end."""
    low = F.lower(text)
    other = reduce(Column.__or__, [text.contains(c) for c in "\t\x0b\x0c\r"])  # translating reads every character
    return F.when(other, F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, line) of all lines; line_no counts from 0."""
    return docs.where("text is not null and doc_id is not null").select("doc_id", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))


def _halves() -> list[Column]:
    """Hashes of a line's halves, null for a short line, which then meets no other class. Between lines of n words each
    an edit leaves the first n div 2 words or as many last ones; between n - 1 and n words, (n - 1) div 2 of them."""
    n, a, b = F.size("w"), (F.size("w") / 2).cast("int"), ((F.size("w") - 1) / 2).cast("int")
    head = lambda k: F.xxhash64(F.lit("head"), F.slice("w", 1, k))
    tail = lambda k: F.xxhash64(F.lit("tail"), F.slice("w", n - k + 1, k))
    long, other = n >= MIN_WORDS, (n >= MIN_WORDS) & (a != b)
    return [F.when(long, head(a)).alias("a1"), F.when(long, tail(a)).alias("z1"), F.when(other, head(b)).alias("a2"), F.when(other, tail(b)).alias("z2")]


def _variants(df: DataFrame) -> DataFrame:
    """``df`` with vs, hashes of the variants of a line ``w`` of ``n`` words with its word at ``lo``, ... ``hi`` - 1 deleted,
    and last that of the line itself.

    The hash of a row of words is the exclusive or of hashes of each word with its place, so all variants come from one
    running value: words before the deleted one keep their places, those behind it move up by one. The running value
    goes by blocks, as each step copies what it has so far. What a function of elements uses stands in a column that is
    used twice, or the optimiser would have it worked out anew for each element.
    """
    xor = lambda a, b: a.bitwiseXOR(b)
    lo, many, none = F.col("lo"), F.col("hi") - F.col("lo"), F.lit(0).cast("long")
    upto = lambda x, first: F.aggregate(x, F.array(first), lambda acc, c: F.concat(acc, F.array(xor(F.element_at(acc, -1), c))))
    df = df.withColumns({"here": F.transform("w", lambda x, j: F.xxhash64(x, j)), "moved": F.transform("w", lambda x, j: F.xxhash64(x, j - 1))})
    start = F.aggregate(F.concat(F.slice("here", 1, lo), F.slice("moved", lo + 1, F.col("n"))), none, xor)
    df = df.withColumns({"steps": F.slice(F.zip_with("here", "moved", xor), lo + 1, many), "start": start, "whole": F.aggregate("here", none, xor), "own": F.slice("moved", lo + 1, many)})
    df = df.withColumn("blocks", F.transform(F.sequence(F.lit(1), F.size("steps"), F.lit(BLOCK)), lambda k: F.slice("steps", k, BLOCK)))
    starts = upto(F.transform("blocks", lambda x: F.aggregate(x, none, xor)), F.col("start"))
    run = F.flatten(F.zip_with(F.slice(starts, 1, F.size("blocks")), "blocks", lambda s, x: upto(F.slice(x, 1, F.size(x) - 1), s)))
    return df.withColumn("vs", F.concat(F.zip_with(run, "own", xor), F.array("whole"))).drop("here", "moved", "steps", "start", "whole", "own", "blocks")


def removed_lines(docs: DataFrame, ws: Workspace, least: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, line_no) of the lines that an earlier line, by (doc_id, line_no), equals or is near to: equal ones
    of at least ``least`` words, near ones of at least MIN_WORDS."""
    at = F.struct("doc_id", "line_no")
    place = F.xxhash64("doc_id", "line_no")
    # a filter on words would have them worked out twice
    lines = _lines(docs).where(F.trim("line") != "").select("doc_id", "line_no", _words(F.col("line")).alias("w"))
    lines = lines.where(F.size("w") >= least) if least > 1 else lines
    lines = ws.put(lines.select("doc_id", "line_no", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("line"), "w").alias("h2"), *_halves()), "lines")
    classes = ws.put(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), (F.count("*") > 1).alias("many"), *[F.max(x).alias(x) for x in HALVES]), "classes")
    halves = classes.select(F.explode(F.array(*HALVES)).alias("half")).where("half is not null")
    met = Sieve(ws, ws.put(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "met"), "met-bits")
    heads, tails = [met.may_hold(F.col(x)) | met.may_hold(F.col(y)) for x, y in (("a1", "a2"), ("z1", "z2"))]
    active = classes.select(F.xxhash64("first.doc_id", "first.line_no").alias("place"), heads.alias("head"), tails.alias("tail"))
    active = ws.put(active.where("head or tail"), "active")
    heads, tails = Sieve(ws, active.where("head").select("place"), "heads"), Sieve(ws, active.where("tail").select("place"), "tails")
    # the words of the active classes, from their first lines; a line that passes by chance only adds to what is compared
    words = _lines(docs).select("doc_id", "line_no", "line", place.alias("place"))
    words = words.select("doc_id", "line_no", "line", heads.may_hold(F.col("place")).alias("head"), tails.may_hold(F.col("place")).alias("tail"))
    words = ws.put(words.where("head or tail").select(at.alias("at"), "head", "tail", _words(F.col("line")).alias("w")).where(F.size("w") >= MIN_WORDS), "words")
    # who shares its first half differs behind it, who shares its last half before that
    part = F.expr("(n - 1) div 2").cast("int")
    cut = words.select("at", "w", "head", "tail", F.size("w").alias("n")).withColumns({"lo": F.when(F.col("tail"), F.lit(0)).otherwise(part), "hi": F.when(F.col("head"), F.col("n")).otherwise(F.col("n") - part)})
    cut = _variants(cut).select("at", "lo", "hi", F.col("n").cast("long").alias("n"), F.posexplode_outer("vs").alias("k", "v"))  # outer: else a filter on vs would work it out again
    cut = cut.select("at", "n", "v", F.when(F.expr("k < hi - lo"), F.col("lo") + F.col("k")).otherwise(F.col("n")).alias("i"))
    n, i, side = F.col("n"), F.col("i"), F.col("side")
    # beside the hash stand length and place of a replaced word, or the number of words left, below 0
    swap = F.struct(F.col("v").alias("key"), (n * 65536 + i + 1).alias("tag"), F.lit(0).cast("byte").alias("side"))
    drop = F.struct(F.col("v").alias("key"), (-(n - 1)).alias("tag"), F.lit(1).cast("byte").alias("side"))
    whole = F.struct(F.col("v").alias("key"), (-n).alias("tag"), F.lit(2).cast("byte").alias("side"))
    keys = ws.put(cut.select("at", F.inline(F.when(i < n, F.array(swap, drop)).otherwise(F.array(whole)))), "keys")
    least_of = lambda *sides: F.min(F.when(side.isin(*sides), F.col("at")))
    meet = keys.groupBy("key", "tag").agg(least_of(0, 2).alias("even"), least_of(1).alias("long"), F.count("*").alias("m"))
    # groups in which some line can be later than the one looked for: a replaced word's of two lines, a whole line's with a longer one
    meet = ws.put(meet.where("m > 1 and (tag > 0 or (even is not null and long is not null))").drop("m"), "meet")
    common = Sieve(ws, meet.select(F.xxhash64("key", "tag").alias("key")), "meet-bits")
    # a replaced word: the smallest of the group; a whole line: the smallest longer line; a longer line: the whole one
    near = keys.where(common.may_hold(F.xxhash64("key", "tag"))).join(meet, ["key", "tag"]).select("at", F.when(side == 2, F.col("long")).otherwise(F.col("even")).alias("by"))
    near = ws.put(near.where("by < at").distinct(), "near")
    ends = Sieve(ws, ws.put(near.select(F.explode(F.array("at", "by")).alias("x")).select(F.xxhash64("x.doc_id", "x.line_no").alias("place")).distinct(), "ends"), "ends-bits")
    found = words.select("at", "w").where(ends.may_hold(F.xxhash64("at.doc_id", "at.line_no")))
    both = near.join(found.withColumnRenamed("w", "a"), "at").join(found.select(F.col("at").alias("by"), F.col("w").alias("b")), "by")
    near = both.where(within_one(F.col("a"), F.col("b"))).select(F.col("at").alias("first"), F.lit(True).alias("near")).distinct()
    # lines of classes that hold more than one, or whose first line is near to an earlier one
    near = ws.put(near, "near-first")
    late = Sieve(ws, near.select(F.xxhash64("first.doc_id", "first.line_no")), "late")
    some = classes.where(F.col("many") | late.may_hold(F.xxhash64("first.doc_id", "first.line_no"))).select("h1", "h2", "first", "many")
    gone = ws.put(some.join(near, "first", "left").where("many or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "gone-classes")
    bits = Sieve(ws, gone.select("h1"), "gone-bits")
    out = lines.where(bits.may_hold(F.col("h1"))).select("doc_id", "line_no", "h1", "h2").join(gone, ["h1", "h2"])
    out = out.where(F.col("near") | (at != F.col("first")))
    out = ws.put(out.select("doc_id", "line_no").distinct(), "gone")
    ws.free("lines", "classes", "met", "active", "words", "keys", "meet", "near", "near-first", "ends", "gone-classes")
    return out


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one put in, taken out or replaced word apart."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    p = F.array_position(same, False).cast("int")  # the first place where they differ, 0 if none
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    less = F.concat(F.slice(long, F.lit(1), F.greatest(p - 1, F.lit(0))), F.slice(long, p + 1, F.size(long)))
    swap = F.size(F.filter(same, lambda x: ~x)) <= 1
    return F.when(F.size(a) == F.size(b), swap).when(F.abs(F.size(a) - F.size(b)) == 1, less == short).otherwise(F.lit(False))


def dedup_lines(docs: DataFrame, ws: Workspace, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each line removed that an earlier line of the whole table equals or is near to.

    Earlier: by (doc_id, number of the line). Lines are compared by their words, lower-cased and split at ASCII white
    space; those of fewer than MIN_WORDS words go only if they equal an earlier one and have at least ``least`` words
    (op5 and the pipeline: 1); empty ones stay. Adds n_lines and
    n_removed (long; 0 lines for null text, which stays null); a text all of whose lines go becomes empty. Texts are
    whole; rows with a null doc_id stay as they are; of rows that repeat a doc_id each loses the lines that its doc_id
    loses by number; an empty table gives no rows; all other columns stay (any named n_lines or n_removed are replaced).
    """
    gone = removed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ws, least)
    gone = ws.put(gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("line_no").alias("_gone")), "by-doc")
    bits = Sieve(ws, gone.select(F.xxhash64("_gone_id")), "by-doc-bits")
    docs = docs.drop("n_lines", "n_removed")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    touched = F.col("doc_id").isNotNull() & bits.may_hold(F.xxhash64(F.col("doc_id").cast("long")))
    whole = docs.where(~touched).select(*columns, n.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    some = docs.where(touched).join(gone.hint("merge"), F.col("doc_id") == F.col("_gone_id"), "left").withColumn("_lines", F.split("text", "\n"))
    nos = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(nos, lambda k: F.get("_lines", k)), "\n"))
    less = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size(nos)).cast("long")
    some = some.withColumns({"n_lines": n, "n_removed": less, "_text": text}).drop("text").withColumnRenamed("_text", "text")
    return whole.unionByName(some.select(*columns, "n_lines", "n_removed"))


def op5_deletion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Workspace(spark, "op5"), least=1)


#: An equal earlier line, or for lines of five words or more one within one edit, found by joining halves and comparing word by word.
SQL = """
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), l AS (
  SELECT doc_id, i - 1 AS line_no, list_filter(regexp_split_to_array(lower(ls[i]), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), lines AS (
  SELECT doc_id, line_no, w, len(w) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS o FROM l WHERE len(w) >= 1
), classes AS (
  SELECT w, any_value(n) AS n, min(o) AS o FROM lines GROUP BY w
), keyed AS (
  SELECT *, unnest([
    {'s': 0, 'm': n, 'p': w[1:(n // 2)]}, {'s': 1, 'm': n, 'p': w[(n - n // 2 + 1):n]},
    {'s': 0, 'm': -n, 'p': w[1:((n - 1) // 2)]}, {'s': 1, 'm': -n, 'p': w[(n - (n - 1) // 2 + 1):n]},
    {'s': 0, 'm': -n - 1, 'p': w[1:(n // 2)]}, {'s': 1, 'm': -n - 1, 'p': w[(n - n // 2 + 1):n]}]) AS k FROM classes WHERE n >= 5
), pairs AS (
  SELECT DISTINCT a.o, a.w AS x, b.w AS y, a.n AS xn, b.n AS yn FROM keyed a JOIN keyed b ON a.k = b.k AND b.o < a.o AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT o FROM pairs WHERE
    (xn = yn AND len(list_filter(range(1, xn + 1), lambda i: x[i] <> y[i])) <= 1)
    OR (xn = yn + 1 AND len(list_filter(range(1, xn + 1), lambda i: list_concat(x[1:(i - 1)], x[(i + 1):xn]) = y)) > 0)
    OR (yn = xn + 1 AND len(list_filter(range(1, yn + 1), lambda i: list_concat(y[1:(i - 1)], y[(i + 1):yn]) = x)) > 0)
), gone AS (
  SELECT doc_id, line_no FROM lines JOIN classes USING (w) WHERE lines.o <> classes.o OR classes.o IN (SELECT o FROM near)
), g AS (SELECT doc_id, list(line_no) AS nos FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN nos IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(nos, i - 1)), lambda i: string_split(d.text, chr(10))[i]), chr(10)) END AS text,
  coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN g USING (doc_id)
"""
