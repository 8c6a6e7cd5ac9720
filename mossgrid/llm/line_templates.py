"""Line dedup by a log-template tree of fixed depth.

A line's place in the tree is its number of tokens and its first ``LEADING`` tokens; a token
with a digit is a variable field from the start. In a leaf that at least ``MIN_DOCS``
documents reach, fields that vary are generalised: at each position the token that most
lines carry stands in the template if at least ``MIN_DOCS`` lines carry it, else the field is
variable. A line belongs to its leaf's template if it agrees in at least ``AGREEMENT`` of all
positions. A template recurs if lines of at least ``MIN_DOCS`` documents belong to it; so
does a line that, its variable fields apart, is the same in that many documents. Of all lines
of a recurring template only the first stays (lowest document id, then position).
In a line whose every token has a digit nothing is variable: a template has at least one
constant token, so rows of different numbers are not alike.
Lines of fewer than ``LEADING`` tokens are no templates and stay in the query, as in its SQL;
with ``short`` each whole masked line is a leaf, so they go by the same test.

With ``several`` (the query and its SQL have one) a leaf has many templates, found in one
pass: of a line that fits not the first, the tokens that lines of ``MIN_DOCS`` documents carry
at their place are ranked by how many do (then by place), and the line goes into one node for
each of ``DEPTHS``: that of its first so many ranked tokens beyond the leading ones; into one of
as many of all its ranked tokens as it must agree with; and into one of its last ranked token
alone, which tells templates whose variable field takes few values. Every node has its
majority template, and equal templates of a leaf are one. A line belongs to the template of
its shallowest node that it fits and that recurs.

Work at scale: leaves are counted first, on hashes alone; only lines of recurring leaves are
shuffled (a bitmap of fixed size holds back the others). No group is collected: counts and
majorities are aggregates that combine before the shuffle. Both sides of a join are tables
written before it, so the rows of a line that a third of all documents hold can be split among
tasks by the adaptive planner.

Nulls and ties: null or empty texts have no lines and stay as they are. Rows with equal id
and text count as one document and are cleaned alike; null ids sort first. Of tokens that
equally many lines carry the greater string wins. An empty table gives no rows. All columns
of the input are kept; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, drop_staged, possible, read, staged

LEADING = 3
MIN_DOCS = 5
AGREEMENT = 0.7
#: Ranked tokens that name a node where a leaf has several templates; 0 is the whole leaf.
DEPTHS = (0, 1, 2, 4)
_FIELD = "<*>"


def _masked(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit("[0-9]")), F.lit(_FIELD)).otherwise(token)


def _bare(tokens: str) -> Column:
    """Whether a line has no token but variable fields; then they stand for themselves."""
    return F.forall(tokens, lambda x: F.regexp_like(x, F.lit("[0-9]")))


def _lines(docs: DataFrame, id_col: str, text: str, short: bool = False) -> DataFrame:
    """key, doc_id, pos, line, leaf of every line with enough tokens (``short``: with any)."""
    own = docs.select(F.xxhash64(F.col(id_col), F.col(text)).alias("key"), F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("pos", "line"))
    own = own.withColumn("tokens", F.array_remove(F.split("line", SPACES), "")).where(F.size("tokens") >= (1 if short else LEADING))
    own = own.withColumn("bare", _bare("tokens"))
    leading = [F.get("tokens", F.lit(k)) for k in range(LEADING)]
    return own.withColumn("leaf", F.xxhash64(F.size("tokens"), *[F.when(F.col("bare"), x).otherwise(_masked(x)) for x in leading]))


def _carried(kinds: DataFrame, by: list[str]) -> DataFrame:
    """n documents, about, that carry a token at a position."""
    return kinds.select(*by, "n_docs", F.posexplode("tokens").alias("at", "token")).groupBy(*by, "at", "token").agg(F.sum("n_docs").alias("n"))


def _judged(kinds: DataFrame, carried: DataFrame, by: list[str], min_docs: int, agreement: float, held: list[str] | None = None) -> DataFrame:
    """Whether kinds of lines fit the majority template of their group; kind: its hash."""
    best = carried.groupBy(*by, "at").agg(F.max(F.struct("n", "token")).alias("top"))
    best = best.select(*by, "at", F.when(F.col("top.n") >= min_docs, F.col("top.token")).alias("token"))
    template = best.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    # a hash passes over nulls; no token is a space
    template = staged(template.withColumn("kind", F.xxhash64(F.transform("template", lambda x: F.coalesce(x, F.lit(" "))))), "templates", held)
    agree = F.aggregate(F.zip_with("tokens", "template", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return kinds.join(template, by).select(*by, "same", "n_docs", "tokens", "kind", (agree >= agreement * F.size("tokens")).alias("fits"))


def _further(kinds: DataFrame, found: DataFrame, keys: DataFrame, min_docs: int, agreement: float) -> DataFrame:
    """leaf, same, kind of lines that belong to further templates of their leaf. ``found``:
    leaf and same of those that belong to the first; ``keys``: leaf, same, key.

    The jobs are as many whatever a leaf holds: all nodes of all depths are judged at once."""
    held: list[str] = []
    rest = kinds.join(found, ["leaf", "same"], "left_anti").select("leaf", "same", "n_docs", "tokens")
    often = staged(_carried(rest, ["leaf"]).where(F.col("n") >= min_docs), "often", held)
    spots = rest.select("leaf", "same", F.posexplode("tokens").alias("at", "token")).join(often, ["leaf", "at", "token"])
    ranked = spots.groupBy("leaf", "same").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", "token"))).alias("ranked"))
    # a template's tokens are carried by min_docs documents, also among all lines of its leaf;
    # a line that has too few such tokens belongs to no template
    rest = rest.join(staged(ranked, "ranked", held), ["leaf", "same"]).where(F.size("ranked") >= agreement * F.size("tokens"))
    free = F.filter("ranked", lambda x: x["at"] >= LEADING)
    first = [F.slice(free, 1, d) for d in DEPTHS] + [F.slice("ranked", F.lit(1), F.ceil(F.lit(agreement) * F.size("tokens")).cast("int")), F.slice(free, -1, 1)]
    nodes = F.array(*[F.xxhash64(F.transform(x, lambda y: F.struct(y["at"], y["token"]))) for x in first])
    rest = staged(rest.select("leaf", "same", "n_docs", "tokens", nodes.alias("nodes")), "rest", held)

    by = ["leaf", "depth", "node"]
    wide = rest.select("leaf", "n_docs", F.posexplode("nodes").alias("depth", "node")).groupBy(*by).agg(F.sum("n_docs").alias("total"))
    wide = staged(wide.where(F.col("total") >= min_docs).select(*by), "wide", held)
    placed = staged(rest.select("leaf", "same", "n_docs", "tokens", F.posexplode("nodes").alias("depth", "node")).join(wide, by), "placed", held)
    fits = _judged(placed, _carried(placed, by), by, min_docs, agreement, held).where("fits")
    fits = staged(fits.select("leaf", "same", "depth", "kind"), "fits", held)
    keys = staged(keys.join(fits.select("leaf", "same").distinct(), ["leaf", "same"]).distinct(), "keys", held)
    recurs = keys.join(fits, ["leaf", "same"]).select("leaf", "kind", "key").distinct().groupBy("leaf", "kind").count().where(F.col("count") >= min_docs)
    chosen = fits.join(staged(recurs.select("leaf", "kind"), "recurs", held), ["leaf", "kind"])
    chosen = chosen.groupBy("leaf", "same").agg(F.min(F.struct("depth", "kind")).alias("least")).select("leaf", "same", F.col("least.kind").alias("kind"))
    chosen = staged(chosen, "further")
    drop_staged(kinds.sparkSession, held)
    return chosen


def recurring(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, agreement: float = AGREEMENT, short: bool = False, several: bool = False) -> DataFrame:
    """key, pos of the lines that go."""
    lines = _lines(docs, id_col, text, short)
    # sides of joins are written first: a hot key's rows can then be split among tasks
    leaves = staged(lines.select("leaf", "key").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    own = possible(lines.select("leaf", "key", "doc_id", "pos", "line"), leaves, ["leaf"]).join(leaves, "leaf")  # a line is shuffled as text and cut again
    own = own.withColumn("tokens", F.array_remove(F.split("line", SPACES), ""))
    own = own.select("leaf", "key", "doc_id", "pos", F.when(_bare("tokens"), F.col("tokens")).otherwise(F.transform("tokens", _masked)).alias("tokens"))
    own = staged(own.withColumn("same", F.xxhash64("tokens")), "lines")

    kinds = own.select("leaf", "same", "key", "tokens").groupBy("leaf", "same", "key").agg(F.first("tokens").alias("tokens"))
    kinds = kinds.groupBy("leaf", "same").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    kinds = staged(kinds, "kinds")
    judged = staged(_judged(kinds, _carried(kinds, ["leaf"]), ["leaf"], min_docs, agreement).drop("tokens", "kind"), "judged")
    fits = own.select("leaf", "same", "key").join(judged.where("fits").select("leaf", "same"), ["leaf", "same"])
    fitting = fits.select("leaf", "key").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf", F.lit(True).alias("recurs"))
    judged = judged.join(staged(fitting, "fitting"), "leaf", "left")
    by_template = F.col("fits") & F.coalesce(F.col("recurs"), F.lit(False))
    if several:
        judged = staged(judged.withColumn("fits", by_template).drop("recurs"), "first")
        further = _further(kinds, judged.where("fits").select("leaf", "same"), own.select("leaf", "same", "key"), min_docs, agreement)
        judged = judged.join(further, ["leaf", "same"], "left")
        kind = F.when(F.col("fits"), F.lit(0)).when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("n_docs") >= min_docs, F.col("same"))
        judged = judged.select("leaf", "same", kind.alias("kind")).where("kind is not null")
    else:
        judged = judged.where(by_template | (F.col("n_docs") >= min_docs)).select("leaf", "same", F.when(by_template, F.lit(0)).otherwise(F.col("same")).alias("kind"))

    gone = staged(own.select("leaf", "same", "key", "doc_id", "pos").join(staged(judged, "recurring"), ["leaf", "same"]).select("leaf", "kind", "key", "doc_id", "pos"), "gone")
    first = staged(gone.groupBy("leaf", "kind").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first")), "firsts")
    gone = gone.join(first, ["leaf", "kind"])
    return gone.where(~((F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos")))).select("key", "pos").distinct()


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that go, and ``n_dropped``, their number."""
    gone = recurring(docs, id_col, text, **options).groupBy(F.col("key").alias("gone_key")).agg(F.collect_set("pos").alias("gone_pos"))
    keyed = docs.withColumn("line_key", F.xxhash64(F.col(id_col), F.col(text)))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("gone_pos"), i)), "\n")
    out = keyed.join(gone, F.col("line_key") == F.col("gone_key"), "left")
    out = out.withColumn("n_dropped", F.when(F.col("gone_pos").isNull(), F.lit(0)).otherwise(F.size("gone_pos")).cast("long"))
    return out.withColumn(text, F.when(F.col("gone_pos").isNull(), F.col(text)).otherwise(kept)).drop("line_key", "gone_key", "gone_pos")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped lines, and length and digest of the text that stays."""
    out = clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l1 AS (SELECT doc_id, text, pos, list_filter(regexp_split_to_array(line, '{SPACES}'), lambda x: x <> '') AS raw FROM l0),
l AS (SELECT doc_id, text, pos, CASE WHEN len(list_filter(raw, lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 THEN raw ELSE list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{_FIELD}' ELSE x END) END AS tokens FROM l1),
m AS (SELECT doc_id, text, pos, tokens, {{'n': len(tokens), 'a': tokens[1], 'b': tokens[2], 'c': tokens[3]}} AS leaf, array_to_string(tokens, ' ') AS same FROM l WHERE len(tokens) >= {LEADING}),
own AS (SELECT m.* FROM m JOIN (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, text FROM m) GROUP BY leaf HAVING count(*) >= {MIN_DOCS}) USING (leaf)),
kinds AS (SELECT leaf, same, any_value(tokens) AS tokens, count(*) AS n_docs FROM (SELECT leaf, same, doc_id, text, any_value(tokens) AS tokens FROM own GROUP BY leaf, same, doc_id, text) GROUP BY leaf, same),
ex AS (SELECT leaf, n_docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM kinds),
carried AS (SELECT leaf, spot, token, sum(n_docs) AS n FROM ex GROUP BY leaf, spot, token),
best AS (SELECT leaf, spot, max({{'n': n, 'token': token}}) AS top FROM carried GROUP BY leaf, spot),
tmpl AS (SELECT leaf, spot, top.token AS token FROM best WHERE top.n >= {MIN_DOCS}),
ke AS (SELECT leaf, same, n_docs, len(tokens) AS n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM kinds),
judged AS (SELECT ke.leaf, ke.same, any_value(n_docs) AS n_docs, count(tmpl.token) >= {AGREEMENT} * any_value(n) AS fits FROM ke LEFT JOIN tmpl ON ke.leaf = tmpl.leaf AND ke.spot = tmpl.spot AND ke.token = tmpl.token GROUP BY ke.leaf, ke.same),
fitting AS (SELECT leaf FROM (SELECT DISTINCT own.leaf, doc_id, text FROM own JOIN judged ON own.leaf = judged.leaf AND own.same = judged.same AND fits) GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
j2 AS (SELECT judged.leaf, same, CASE WHEN fits AND fitting.leaf IS NOT NULL THEN '' ELSE same END AS kind FROM judged LEFT JOIN fitting USING (leaf) WHERE n_docs >= {MIN_DOCS} OR (fits AND fitting.leaf IS NOT NULL)),
gone AS (SELECT own.doc_id, own.text, own.pos, row_number() OVER (PARTITION BY own.leaf, kind ORDER BY own.doc_id, own.pos) AS r FROM own JOIN j2 ON own.leaf = j2.leaf AND own.same = j2.same),
n AS (SELECT doc_id, text, list(pos) AS ps FROM gone WHERE r > 1 GROUP BY doc_id, text),
k AS (SELECT documents.doc_id, coalesce(len(ps), 0)::BIGINT AS n_dropped, CASE WHEN ps IS NULL THEN documents.text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(documents.text, chr(10))) + 1), lambda i: NOT list_contains(ps, i)), lambda i: string_split(documents.text, chr(10))[i]), chr(10)) END AS kept FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id AND documents.text = n.text)
SELECT doc_id, n_dropped, length(kept)::BIGINT AS n_kept_chars, md5(kept) AS kept_md5 FROM k
"""
