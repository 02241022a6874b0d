"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers (in digits or words), names and units become typed placeholders, so that a question asked anew with other values
keeps its template. A name is a run of words with a capital and a small letter, however many, at the start of a sentence
as elsewhere. Windows of ``WIDTH`` template words of every document are joined by hash with those of the benchmark. For
each pair of document and item, the windows found along one alignment (the same distance between their places) are put
together. The values in the placeholders are held against the item's: each value must stand for one value throughout,
or the match is a chance one. What is a name hangs on capitals, so windows of the plain lower-cased words are joined, too:
they find copies as they stand, whatever their capitals. A document leaks an item if at least ``SHARE`` tenths of the
item's plain windows are in it, or of its template windows along one alignment with consistent slots.

A window's hash is tested against a sieve of the benchmark's before anything else of the window is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Sieve, Workspace, read

WIDTH = 5
#: A leak has at least so many tenths of the item's windows.
SHARE = 8
#: Items of fewer words than WIDTH are one window of them all; those of fewer than this say nothing in a longer text and
#: leak only in a document of the same words.
LEAST = 3
#: Benchmark windows that are broadcast at most; a larger benchmark is joined by a shuffle.
BROADCAST_WINDOWS = 400_000

#: Units of measure, as whole words after a number; numbers in words.
UNITS = "km|m|cm|mm|kg|g|mg|lb|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|inches|grams?|liters?|litres?|dollars?|euros?|cents?|percent|%|mph|kph|usd|eur"
NUMERALS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
#: A word of a name; two of them, of which the second may begin the next pair, so it takes two passes to join a run.
NAME = "[A-ZÀ-Þ][a-zß-ÿ][A-Za-zÀ-ÿ'’-]*"
PAIR = f"({NAME}) ([A-ZÀ-Þ][a-zß-ÿ])"
JOINT = "\x01"
NAMES = f"[A-ZÀ-Þ][a-zß-ÿ][A-Za-zÀ-ÿ'’{JOINT}-]*"
NUMBER = "(^|[\\x20\\x09-\\x0D(\\[$])[-+]?[0-9][0-9.,/]*[0-9]|(^|[\\x20\\x09-\\x0D(\\[$])[-+]?[0-9]"
IN_WORDS = f"(^|[\\x20\\x09-\\x0D(\\[$])(?:{NUMERALS})(?:-(?:{NUMERALS}))?([\\x20\\x09-\\x0D.,;:!?)]|$)"
UNIT = f"(<num>[.,;]? )(?:{UNITS})([.,;:!?)]*)(\\x20|\\x09|\\n|\\r|$)"


def with_template(df: DataFrame) -> DataFrame:
    """``df`` with own, the lower-cased text with each run of name words joined to one word, and tpl, the same with
    placeholders, a word for a word. Each step is a projection of its own, as the optimiser then works it out once."""
    df = df.withColumn("own", F.regexp_replace("text", PAIR, f"$1{JOINT}$2"))
    df = df.withColumn("own", F.when(F.col("own").contains(JOINT), F.regexp_replace("own", PAIR, f"$1{JOINT}$2")).otherwise(F.col("own")))
    df = df.withColumn("tpl", F.lower(F.regexp_replace("own", NAMES, "<name>"))).withColumn("own", F.lower("own"))
    for _ in range(2):  # matches can't overlap
        df = df.withColumn("tpl", F.regexp_replace("tpl", IN_WORDS, "$1<num>$2"))
    df = df.withColumn("tpl", F.when(F.col("tpl").rlike("[0-9]"), F.regexp_replace("tpl", NUMBER, "$1$2<num>")).otherwise(F.col("tpl")))
    return df.withColumn("tpl", F.when(F.col("tpl").contains("<num> ") | F.col("tpl").rlike("<num>[.,;] "), F.regexp_replace("tpl", UNIT, "$1<unit>$2$3")).otherwise(F.col("tpl")))


def _words(text: Column) -> Column:
    other = reduce(Column.__or__, [text.contains(c) for c in "\t\x0b\x0c\r"])  # translating reads every character
    plain = F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    return F.array_remove(F.split(F.replace(plain, F.lit("\n"), F.lit(" ")), " "), "")


def _hash(words: str, at: Column, width: int, plain: bool) -> Column:
    return F.xxhash64(F.lit(plain), F.lit(width), *[F.get(words, at + k) for k in range(width)])


def _rows(df: DataFrame, keys: list[str], words: str, widths: list[int], plain: bool, sieve: Sieve | None) -> DataFrame:
    """Rows (keys, at, width, h, tpl, raw): the windows of ``words`` that pass the sieve. Only an item's last window is
    shorter than WIDTH, if the item is."""
    out, carried = None, [] if plain else ["own", "tpl"]
    for width in widths:
        at = F.col("at")
        # outer: else the optimiser adds a filter on the words, which works them out again
        one = df.select(*keys, *carried, *([words] if plain else []), F.posexplode_outer(words).alias("at", "_"))
        one = one.where(at + width <= F.size(words)).withColumn("h", _hash(words, at, width, plain))
        one = one.where(sieve.may_hold(F.col("h"))) if sieve else one
        some = [F.lit(None).cast("array<string>") if plain else F.slice(c, at + 1, width) for c in ("tpl", "own")]
        one = one.select(*keys, "at", F.lit(width).alias("width"), "h", some[0].alias("tpl"), some[1].alias("raw"))
        out = one if out is None else out.unionByName(one)
    return out


def _split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The words of texts: plain ones, and those of templates with what stands behind each."""
    plain = df.select(*keys, _words(F.lower("text")).alias("w"))
    made = with_template(df.select(*keys, "text"))
    return plain, made.select(*keys, _words(F.col("own")).alias("own"), _words(F.col("tpl")).alias("tpl"))


def matches(docs: DataFrame, benchmark: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, item_id): the leaks of ``docs`` (doc_id, text) from ``benchmark`` (item_id, text)."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct().withColumn("uid", F.xxhash64("item_id", "text"))
    items, sides = ws.put(items, "items"), []
    for k, df in enumerate(_split(items, ["item_id", "uid"])):
        df = ws.put(df, f"items-{k}")
        words = "tpl" if k else "w"
        size = F.least(F.size(words), F.lit(width))
        parts = [_rows(df.where(size == n), ["item_id", "uid"], words, [n], not k, None) for n in range(1, width + 1)]
        sides.append(ws.put(reduce(DataFrame.unionByName, parts).withColumnsRenamed({"at": "k", "raw": "own"}), f"windows-{k}"))
    docs = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    best = []
    for k, (bench, df) in enumerate(zip(sides, _split(docs, ["doc_id"]))):
        words = "tpl" if k else "w"
        widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # at most WIDTH
        if not widths:
            continue
        count = bench.count()
        side = F.broadcast(bench) if count <= BROADCAST_WINDOWS else bench
        total = bench.groupBy("item_id", "uid", "width").agg(F.count("*").alias("total"))
        hits = _rows(df, ["doc_id"], words, widths, not k, Sieve(ws, bench.select("h"), f"bits-{k}")).drop("tpl").join(side.drop("width"), "h")
        # items of one or two words: only in a document that has no others
        if widths[0] < LEAST:
            sizes = df.select(F.col("doc_id").alias("_doc"), F.size(words).alias("_size")).where(F.col("_size") < LEAST).distinct()
            hits = hits.where(F.col("width") >= LEAST).unionByName(hits.where(F.col("width") < LEAST).join(sizes, (F.col("doc_id") == F.col("_doc")) & (F.col("width") == F.col("_size")), "left_semi"))
        hits = ws.put(hits.select("doc_id", "item_id", "uid", "k", (F.col("at") - F.col("k")).alias("line"), "tpl", "raw", "own").distinct(), f"hits-{k}")
        if k:  # along one alignment, with a value for each value
            line = ["doc_id", "item_id", "uid", "line"]
            found = hits.groupBy(*line).agg(F.count_distinct("k").alias("found"))
            slots = hits.select(*line, F.explode(F.arrays_zip("tpl", "own", "raw")).alias("p")).where("p.tpl like '%<%>%'").select(*line, "p.own", "p.raw").distinct()
            bad = slots.groupBy(*line, "own").count().where("count > 1").select(*line).distinct()
            found = found.join(bad, line, "left_anti")
        else:
            found = hits.groupBy("doc_id", "item_id", "uid").agg(F.count_distinct("k").alias("found"))
        small = F.broadcast(total) if count <= BROADCAST_WINDOWS else total
        best.append(found.join(small, ["item_id", "uid"]).where(F.col("found") * 10 >= F.col("total") * SHARE).select("doc_id", "item_id"))
    return reduce(DataFrame.unionByName, best).distinct() if best else docs.select("doc_id", F.lit(None).cast("long").alias("item_id")).limit(0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """``docs`` with item_ids (array<long>, ascending) of the benchmark items that each leaks, and leaked (boolean).

    Words are split at ASCII white space and lower-cased. Null or empty texts leak nothing. An item of fewer than
    ``width`` words is one window of them all, found anywhere in a text; one of fewer than LEAST words only in a document
    of the same words. All rows of an item id count, each text for itself; items with null text are ignored; an empty
    benchmark or table gives no leaks or no rows. Rows that repeat a doc_id share their leaks; rows with a null doc_id
    leak nothing. Texts are whole; all other columns stay (any named item_ids or leaked are replaced).
    """
    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark.select("item_id", "text"), ws, width)
    found = found.groupBy(F.col("doc_id").alias("_leak_id")).agg(F.sort_array(F.collect_set(F.col("item_id").cast("long"))).alias("item_ids"))
    out = docs.drop("item_ids", "leaked").join(found, F.col("doc_id") == F.col("_leak_id"), "left").drop("_leak_id")
    return out.withColumns({"item_ids": F.coalesce("item_ids", F.array().cast("array<bigint>")), "leaked": F.col("item_ids").isNotNull()})


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the items that it leaks, joined by commas."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"), Workspace(spark, "op9"))
    return out.select("doc_id", "leaked", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"))


def _sql_template(text: str, names: bool) -> str:
    """The text with runs of names joined, or that with placeholders."""
    q = lambda x: x.replace("'", "''")
    for _ in range(2):
        text = f"regexp_replace({text}, '{q(PAIR)}', '\\1{JOINT}\\2', 'g')"
    if names:
        return f"lower({text})"
    text = f"lower(regexp_replace({text}, '{q(NAMES)}', '<name>', 'g'))"
    for _ in range(2):
        text = f"regexp_replace({text}, '{IN_WORDS}', '\\1<num>\\2', 'g')"
    text = f"regexp_replace({text}, '{NUMBER}', '\\1\\2<num>', 'g')"
    return f"regexp_replace({text}, '{UNIT}', '\\1<unit>\\2\\3', 'g')"


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _sql_rows(table: str, keys: str, words: str, item: bool) -> str:
    """Windows of a table of (keys, t, w): of an item of at most WIDTH words, of a document of every width up to that."""
    width = f"least(len({words}), {WIDTH})" if item else "n"
    spread = "" if item else f" CROSS JOIN range(1, {WIDTH + 1}) AS r(n)"
    return f"""SELECT {keys}, i - 1 AS at, m, len(ws) AS size, array_to_string(ws[i:(i + m - 1)], ' ') AS h, t[i:(i + m - 1)] AS tpl, w[i:(i + m - 1)] AS raw
  FROM (SELECT {keys}, t, w, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT {keys}, t, w, {words} AS ws, {width} AS m FROM {table}{spread}) WHERE m > 0 AND len(ws) >= m)"""


SQL = f"""
WITH items AS (SELECT item_id, text, row_number() OVER () AS uid FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)),
bt AS (SELECT item_id, uid, {_sql_words(_sql_template("text", False))} AS t, {_sql_words(_sql_template("text", True))} AS w, {_sql_words("lower(text)")} AS p FROM items),
dt AS (SELECT doc_id, {_sql_words(_sql_template("text", False))} AS t, {_sql_words(_sql_template("text", True))} AS w, {_sql_words("lower(text)")} AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
bw AS ({_sql_rows("bt", "item_id, uid", "t", True)}), bp AS ({_sql_rows("bt", "item_id, uid", "p", True)}),
dw AS ({_sql_rows("dt", "doc_id", "t", False)}), dp AS ({_sql_rows("dt", "doc_id", "p", False)}),
hits AS (SELECT DISTINCT doc_id, item_id, uid, b.at AS k, d.at - b.at AS line, b.tpl AS tpl, d.raw AS raw, b.raw AS own FROM dw d JOIN bw b USING (h, m) WHERE m >= {LEAST} OR d.size = m),
plain AS (SELECT DISTINCT doc_id, item_id, uid, b.at AS k FROM dp d JOIN bp b USING (h, m) WHERE m >= {LEAST} OR d.size = m),
slots AS (SELECT DISTINCT doc_id, uid, line, own[i] AS own, raw[i] AS raw FROM (SELECT *, unnest(range(1, len(tpl) + 1)) AS i FROM hits) WHERE tpl[i] LIKE '%<%>%'),
bad AS (SELECT DISTINCT doc_id, uid, line FROM slots GROUP BY doc_id, uid, line, own HAVING count(*) > 1),
lined AS (SELECT doc_id, item_id, uid, count(DISTINCT k) AS found FROM hits ANTI JOIN bad USING (doc_id, uid, line) GROUP BY doc_id, item_id, uid, line),
stands AS (SELECT doc_id, item_id, uid, count(DISTINCT k) AS found FROM plain GROUP BY doc_id, item_id, uid),
tw AS (SELECT uid, count(*) AS n FROM bw GROUP BY 1), tp AS (SELECT uid, count(*) AS n FROM bp GROUP BY 1),
leaks AS (SELECT doc_id, item_id FROM lined JOIN tw USING (uid) WHERE found * 10 >= n * {SHARE} UNION SELECT doc_id, item_id FROM stands JOIN tp USING (uid) WHERE found * 10 >= n * {SHARE}),
g AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM leaks GROUP BY doc_id)
SELECT doc_id, items IS NOT NULL AS leaked, coalesce(items, '') AS items FROM documents LEFT JOIN g USING (doc_id)
"""
