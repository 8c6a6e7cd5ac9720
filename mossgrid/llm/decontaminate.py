"""Benchmark decontamination by template: finds items that are asked again with other
numbers, names or units.

Texts are brought to template form: a number, a name (capitalised words inside a sentence) or
a unit after a number becomes a typed placeholder that remembers its value; everything else
is lower-cased and stripped of punctuation. Windows of ``WINDOW`` template tokens of all
documents are hash-joined to the windows of all items. Matches of one document and item on
one diagonal (document position minus item position) form an alignment; it counts if its
slots are consistent (a value of the item always meets the same value of the document) and
it covers at least ``COVERAGE`` of the item's windows. Windows with fewer than ``FIXED``
tokens that are not slots are no evidence and are left out on the item's side.

The items' windows (which do not grow with the documents) are broadcast after their number
has been checked; beyond ``BROADCAST_WINDOWS`` the same join shuffles by hash. Texts with an
alignment are shuffled to it for the values of its slots, the others are not. Matches are grouped by document and
item, so a passage that many documents share makes no large group. All of it is DataFrame
functions.

Names are told by their capitals, which fails where a text or an item is in other case. So
``decontaminated`` also joins windows of a case-blind form (lower case, numbers and units
typed, no names) and drops documents that reach the coverage in either form; the query
``leaks`` has the first form alone, as its SQL does.

Nulls and ties: null texts have no tokens and match nothing; texts and items of fewer than
``WINDOW`` tokens have no window. Rows with equal id and text are one document; rows with
equal id and other text are judged together. Ids may be null. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import possible, read, staged, without

WINDOW = 8
FIXED = 4
COVERAGE = 0.5
#: Items' windows up to which they are broadcast (about 40 bytes each).
BROADCAST_WINDOWS = 500_000

#: Units of measure that may follow a number.
UNITS = "km cm mm m kg g mg lb oz l ml km/h mph hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents miles mile meters meter metres metre feet inches percent degrees".split()
_UNIT = "|".join(sorted(UNITS, key=lambda x: (-len(x), x)))
#: Pattern, replacement; \x01 marks a slot, the letter after it its type. Applied in order.
STEPS = [
    ("([\\p{Ll},;:] )(\\p{Lu}\\p{L}+( \\p{Lu}\\p{L}+)*)", "$1\x01a$2\x02"),
    ("([0-9]+([.,][0-9]+)*)", " \x01n$1\x02 "),
    (f"(\x02 +)({_UNIT})([^\\p{{L}}]|$)", "$1\x01u$2\x02 $3"),
]


def marked(text: Column, blind: bool = False) -> Column:
    """Template tokens of a text; a slot is \\x01, its type and its value (spaces as _).
    ``blind``: in any case, without slots for names."""
    out = F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "")
    out = F.lower(out) if blind else out
    for pattern, new in STEPS[1:] if blind else STEPS:
        # Java repeats a group by recursion, one level a name or number, unless it gives nothing
        # back; as these groups are the last of their patterns, nothing is ever asked back
        out = F.regexp_replace(out, pattern.replace(")*", ")*+"), new)
    return F.array_remove(F.split(F.lower(F.regexp_replace(out, "[^\\p{L}\\p{N}\x01]+", " ")), " "), "")


def _template(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit("\x01")), F.substr(token, F.lit(1), F.lit(2))).otherwise(token)


def _windowed(df: DataFrame) -> DataFrame:
    """Adds ``h``: hashes of the windows at each start, from token hashes by doubling."""
    df = df.withColumn("h", F.transform("tokens", lambda x: F.xxhash64(_template(x))))
    for step in (1, 2, 4):
        df = df.withColumn("h", F.zip_with("h", F.slice("h", step + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return df.withColumn("h", F.slice("h", 1, F.greatest(F.size("tokens") - (WINDOW - 1), F.lit(0))))


def _items(benchmark: DataFrame, item_col: str, text: str, blind: bool = False) -> DataFrame:
    """item_key, item_id, tokens of the different items."""
    items = benchmark.select(F.col(item_col).alias("item_id"), marked(F.col(text), blind).alias("item_tokens")).distinct()
    return items.select(F.xxhash64("item_id", "item_tokens").alias("item_key"), "item_id", "item_tokens")


def items_windows(items: DataFrame) -> DataFrame:
    """h, item_key, j (start), n_item (windows of the item's id)."""
    own = _windowed(items.withColumnRenamed("item_tokens", "tokens")).select("item_key", "item_id", "tokens", F.posexplode_outer("h").alias("j", "h")).where("j is not null")
    own = own.where(F.size(F.filter(F.slice("tokens", F.col("j") + 1, WINDOW), lambda x: ~F.startswith(x, F.lit("\x01")))) >= FIXED).drop("tokens")
    total = own.groupBy(F.col("item_id").alias("total_id")).agg(F.count_distinct("j").alias("n_item"))
    return own.join(total, F.col("item_id").eqNullSafe(F.col("total_id"))).select("h", "item_key", "j", "n_item")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, blind: bool = False) -> DataFrame:
    """doc_id, item_id, n_matched, n_item (windows), reworded (some slot has another value)
    for each item that a document holds; ``blind``: in the case-blind form."""
    items = _items(benchmark, item_col, item_text, blind)
    windows = items_windows(items)
    small = windows.count() <= BROADCAST_WINDOWS
    if small:
        windows = F.broadcast(windows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    # only hashes and places leave the texts: a row per window must stay narrow. An inner
    # explode would make a filter on the array's size that is pushed down with the whole
    # expression, evaluated many times over; the outer one does not
    starts = _windowed(own.withColumn("tokens", marked(F.col("text"), blind))).select("doc_id", "text_key", F.posexplode_outer("h").alias("i", "h")).where("i is not null")
    hits = starts.join(windows, "h").withColumn("diagonal", F.col("i") - F.col("j"))
    lines = hits.groupBy("doc_id", "text_key", "item_key", "diagonal").agg(F.first("n_item").alias("n_item"), F.collect_set("j").alias("js"))
    lines = staged(lines.where(F.size("js") >= coverage * F.col("n_item")), "alignments")
    found = lines.join(F.broadcast(items) if small else items, "item_key").select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "item_id", "item_tokens", "diagonal", "n_item", "js")
    # the texts of these documents once more, for the values of slots; written, or the
    # optimizer would put the making of tokens into the lambda that runs for each window
    some = possible(own, lines, ["doc_id", "text_key"])
    both = some.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    both = staged(both.select("doc_id", "item_id", "item_tokens", "diagonal", "n_item", "js", marked(F.col("text"), blind).alias("tokens")), "found")
    pairs = F.transform("js", lambda j: F.zip_with(F.slice("item_tokens", j + 1, WINDOW), F.slice("tokens", j + F.col("diagonal") + 1, WINDOW), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    same = F.filter(pairs, lambda w: F.forall(w, lambda x: _template(x["a"]) == _template(x["b"])))  # hashes may collide
    both = both.select("doc_id", "item_id", "n_item", same.alias("same"))
    slots = F.array_distinct(F.filter(F.flatten("same"), lambda x: F.startswith(x["a"], F.lit("\x01"))))
    both = both.select("doc_id", "item_id", "n_item", F.size("same").cast("long").alias("n_matched"), slots.alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["a"])))
    both = both.where(consistent & (F.col("n_matched") >= coverage * F.col("n_item")))
    reworded = F.exists("slots", lambda x: x["a"] != x["b"])
    return both.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_item").alias("n_item"), F.min(reworded).alias("reworded"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item in either form."""
    either = leaks(docs, benchmark, id_col=id_col, **options).unionByName(leaks(docs, benchmark, id_col=id_col, blind=True, **options))
    return without(docs, staged(either.select(F.col("doc_id").alias(id_col)).distinct(), "leaking"), [id_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _sql_marked(text: str) -> str:
    out = f"translate(coalesce({text}, ''), chr(1) || chr(2), '')"
    for pattern, new in STEPS:
        pattern = pattern.replace("\x02", "\\x02")
        new = new.replace("$", "\\").replace("\x01", "' || chr(1) || '").replace("\x02", "' || chr(2) || '")
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split(lower(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\x01]+', ' ', 'g')), ' '), lambda x: x <> '')"


SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_sql_marked('text')} AS tokens FROM documents),
b AS (SELECT DISTINCT item_id, {_sql_marked('text')} AS tokens FROM benchmark),
dt AS (SELECT doc_id, text, unnest(tokens) AS x, generate_subscripts(tokens, 1) AS i FROM d),
bt AS (SELECT item_id, tokens, unnest(tokens) AS x, generate_subscripts(tokens, 1) AS i FROM b),
dm AS (SELECT *, CASE WHEN starts_with(x, chr(1)) THEN x[1:2] ELSE x END AS t FROM dt),
bm AS (SELECT *, CASE WHEN starts_with(x, chr(1)) THEN x[1:2] ELSE x END AS t FROM bt),
dw AS (SELECT doc_id, text, i, concat_ws(' ', {', '.join(['t'] + [f'lead(t, {k}) OVER o' for k in range(1, WINDOW)])}) AS w, [{', '.join(['x'] + [f'lead(x, {k}) OVER o' for k in range(1, WINDOW)])}] AS part, lead(t, {WINDOW - 1}) OVER o AS z FROM dm WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
bw0 AS (SELECT item_id, i, concat_ws(' ', {', '.join(['t'] + [f'lead(t, {k}) OVER o' for k in range(1, WINDOW)])}) AS w, [{', '.join(['x'] + [f'lead(x, {k}) OVER o' for k in range(1, WINDOW)])}] AS part, lead(t, {WINDOW - 1}) OVER o AS z FROM bm WINDOW o AS (PARTITION BY item_id, tokens ORDER BY i)),
bw AS (SELECT *, count(DISTINCT i) OVER (PARTITION BY item_id) AS n_item FROM bw0 WHERE z IS NOT NULL AND len(list_filter(part, lambda x: NOT starts_with(x, chr(1)))) >= {FIXED}),
h AS (SELECT doc_id, text, item_id, n_item, bw.i AS j, dw.i - bw.i AS diagonal, list_filter(list_zip(bw.part, dw.part), lambda s: starts_with(s[1], chr(1))) AS slots FROM dw JOIN bw ON dw.w = bw.w AND dw.z IS NOT NULL),
l AS (SELECT doc_id, text, item_id, diagonal, any_value(n_item) AS n_item, count(DISTINCT j) AS n_matched, list_distinct(flatten(list(slots))) AS slots FROM h GROUP BY doc_id, text, item_id, diagonal),
k AS (SELECT * FROM l WHERE len(slots) = len(list_distinct(list_transform(slots, lambda s: s[1]))) AND n_matched >= {COVERAGE} * n_item)
SELECT doc_id, item_id, max(n_matched) AS n_matched, max(n_item) AS n_item, bool_and(len(list_filter(slots, lambda s: s[1] <> s[2])) > 0) AS reworded FROM k GROUP BY doc_id, item_id
"""
