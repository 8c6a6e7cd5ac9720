"""Quality rules as a short-circuit cascade.

The base figures of a text (words, characters in words, symbols, repeated lines, words in
repeated 8-word windows) are computed for every document. The rules after them only reject,
so their order does not change the verdict, only the work: each rule's cost (seconds over a
sample) and selectivity (share of the sample that it rejects) are measured, the rules are
ordered by rejections per second, and a document that one rule rejects is not given to the
next. All of it is DataFrame functions on one pass without a shuffle.

Nulls and ties: a null text has no words and fails the base check; white space only likewise.
Rows are judged one by one, so repeated rows and null ids each give a row. An empty table
gives no rows (the rules then keep their written order). Other columns are ignored, also
those named like a result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, partitions, read, staged, words

#: Documents in the sample on which costs and selectivities are measured, about.
SAMPLE = 2000
#: Words of a repeated window.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def base(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text, the words ``w`` and the base figures of every document."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("w", words(F.col("text")))
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        df = df.withColumn("h", F.zip_with("h", F.slice("h", step + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("h", F.slice("h", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))
    # only a text with a repeated window sorts its windows and looks at neighbors
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.zip_with("s", F.slice("s", 2, F.size("s")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))))))
    steps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    df = df.withColumn("lines", lines)
    return df.select(
        "doc_id", "text", "w", "lines",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


#: Rules by name: true rejects. Written in an arbitrary order; the cascade finds its own.
RULES: dict[str, Callable[[], Column]] = {
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "adjacent_repeats": lambda: 5 * F.aggregate(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) > F.col("n_words"),
    "capitals": lambda: 10 * F.regexp_count("text", F.lit("\\p{Lu}")) > 3 * F.regexp_count("text", F.lit("\\p{L}")),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "exclamations": lambda: 10 * F.regexp_count("text", F.lit("!")) > F.col("n_words"),
    "repeated_lines": lambda: 2 * F.col("n_dup_lines") > F.size("lines"),
    "digits": lambda: 2 * F.regexp_count("text", F.lit("[0-9]")) > F.col("word_chars"),
}


def measured_order(sample: DataFrame, rules: dict[str, Callable[[], Column]]) -> list[tuple[str, float, float]]:
    """Rules with their rejections and seconds on the sample, best rejection rate first."""
    def run(condition: Column) -> tuple[int, float]:
        began = time.perf_counter()
        n = sample.agg(F.count_if(condition).alias("n")).first()["n"]
        return n or 0, time.perf_counter() - began

    run(F.lit(False))  # compiles and warms up
    idle = run(F.lit(False))[1]
    found = [(name, *run(F.coalesce(rule(), F.lit(False)))) for name, rule in rules.items()]
    found = [(name, float(n), max(s - idle, 1e-3)) for name, n, s in found]
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: dict[str, Callable[[], Column]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Base figures, ``failed_rule`` (the first rule in the measured order that rejects, or
    null) and ``kept`` of every document."""
    rules = RULES if rules is None else rules
    own = docs.select(id_col, text)
    n = own.count()
    order = list(rules)
    if n:
        some = base(own.sample(min(1.0, sample / n), seed=5).repartition(min(4, partitions(docs.sparkSession))), id_col, text)
        order = [x[0] for x in measured_order(staged(some.drop("doc_id"), "sample"), rules)]
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        failed = failed.when(rules[name](), F.lit(name))
    return base(own, id_col, text).withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull()).drop("w", "text", "lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(read(spark, sf_dir, "documents")).drop("failed_rule")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text,
  list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM d),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
v AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o, lead(x, 6) OVER o, lead(x, 7) OVER o) AS k, lead(x, 7) OVER o AS eighth FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v WHERE eighth IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS k FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT t.doc_id, text, w, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN r USING (doc_id)),
c AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 5 * coalesce(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i+1])), 0) > n_words
    OR 10 * length(regexp_replace(text, '\P{Lu}', '', 'g')) > 3 * length(regexp_replace(text, '\P{L}', '', 'g'))
    OR 10 * n_symbols > n_words OR 10 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
    OR 2 * n_dup_lines > len(lines) OR 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars) AS kept
FROM c
"""
