"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Words are runs of letters and digits, lower-cased. Fixed masks say which of the
next words count; their hashes are joined between training texts and benchmark
items, and each hit is verified on the words' own 64-bit hashes: in some
``WINDOW`` consecutive aligned words around it, at most ``MISSES`` differ.
Whatever two words of a window differ, one of the two masks fits between them,
so the seeds miss no such overlap.

An item of fewer words contaminates the texts that hold all its words in a row.

A seed of an item carries the words around it and no more. A benchmark whose
seeds have few enough bytes (``BROADCAST`` is checked) is broadcast; texts are
then read once, and places, seeds, hits and their verification are one
generated loop that only verified hits leave. A larger one is joined by
shuffled seeds, where Spark splits those that many share, and a hit takes only
the words around it along. Nothing within that loop is a lambda, which would
end it and copy a text's words for each of its places.

Defined cases: null and empty texts are not contaminated, and items without
words contaminate nothing; null items are ignored; a null
``doc_id`` is carried; rows with equal ``doc_id`` and text are judged alike;
repeated items are counted by their ids; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import free_name

#: 1 marks words that count. Between them they leave no place for two misses in a window.
MASKS = ("11101011", "110100111")
WINDOW, MISSES = 13, 2
#: Words that an alignment around a seed may reach to either side of its first one, and bytes of a seed with them.
REACH = WINDOW - min(map(len, MASKS))
SEED_BYTES = 8 * (WINDOW + REACH) + 64
#: Bytes of a benchmark's seeds up to which it is broadcast.
BROADCAST = 64 << 20
_P = "__decon_"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _seed(hashes: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k, c in enumerate(mask) if c == "1"))


def _seeds(frame: DataFrame, keep: list[str]) -> DataFrame:
    """keep, hashes, at, seed: a row for each place and mask; past the end a seed is of fewer words and verifies nothing."""
    m, span = len(MASKS), min(map(len, MASKS))
    # a filter on the size would be pushed down and make the words twice
    places = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), (F.size("hashes") - span + 1) * m - 1))
    rows = frame.select(*keep, "hashes", F.explode(places).alias("p"))
    rows = rows.select(*keep, "hashes", F.expr(f"cast(p div {m} as int)").alias("at"), (F.col("p") % m).alias("mask"))
    seed = _seed(F.col("hashes"), F.col("at"), MASKS[0])
    for k, mask in enumerate(MASKS[1:], 1):  # the mask is part of the key
        seed = F.when(F.col("mask") == k, F.shiftrightunsigned(_seed(F.col("hashes"), F.col("at"), mask), k)).otherwise(seed)
    return rows.select(*keep, "hashes", "at", seed.alias("seed"))


def _near(words: str, at: str) -> Column:
    """The words that a hit's verification looks at."""
    return F.slice(words, F.greatest(F.lit(1), F.col(at) - REACH + 1), F.lit(WINDOW + REACH))


def _place(at: str) -> Column:
    """Where the hit's first word stands among them."""
    return F.least(F.col(at), F.lit(REACH))


def _verified(some: DataFrame, keep: list[str]) -> DataFrame:
    """Of rows with own, a, theirs, b (words and places): keep of those that agree in a window with the hit's first word.

    The comparison is the argument of an aggregate: as a filter it would be
    pushed into the join and make the loop over all places too large for the
    compiler. Only hits, with the words around them, leave that loop.
    """
    same = F.transform(F.sequence(F.lit(-REACH), F.lit(WINDOW - 1)), lambda k: F.coalesce(F.get("own", F.col("a") + k) == F.get("theirs", F.col("b") + k), F.lit(False)).cast("int"))
    total = lambda s, first: F.aggregate(F.slice(s, first, F.lit(WINDOW)), F.lit(0), lambda x, y: x + y)
    fits = F.exists(F.sequence(F.lit(1), F.lit(REACH + 1)), lambda first: total(same, first) >= WINDOW - MISSES)
    return some.groupBy(*keep).agg(F.max(fits).alias("fits")).where("fits").select(*keep)


def _whole(texts: DataFrame, items: DataFrame, keep: list[str], lengths: list[int], few: bool) -> DataFrame:
    """keep of the texts that hold all the words of an item with one of these lengths in a row."""
    key = keep[0]
    n = len(lengths)
    places = F.when(F.size("hashes") >= min(lengths), F.sequence(F.lit(0), F.size("hashes") * n - 1))
    rows = texts.select(key, "hashes", F.explode(places).alias("p"))
    rows = rows.select(key, "hashes", F.expr(f"cast(p div {n} as int)").alias("at"), (F.col("p") % n).alias("kind"))
    seed = lambda at, size: F.xxhash64(F.lit(size), *(F.get("hashes", at + k) for k in range(size)))
    of_text = seed(F.col("at"), lengths[0])
    of_item = seed(F.lit(0), lengths[0])
    for k, size in enumerate(lengths[1:], 1):
        of_text = F.when(F.col("kind") == k, seed(F.col("at"), size)).otherwise(of_text)
        of_item = F.when(F.size("hashes") == size, seed(F.lit(0), size)).otherwise(of_item)
    length = F.element_at(F.array(*map(F.lit, lengths)), (F.col("kind") + 1).cast("int"))
    marks = items.select("item_id", F.col("hashes").alias("theirs"), of_item.alias("seed"))
    hits = rows.select(key, F.slice("hashes", F.col("at") + 1, length).alias("own"), of_text.alias("seed")).join(F.broadcast(marks) if few else marks, "seed")
    return hits.groupBy(*keep).agg(F.max(F.col("own") == F.col("theirs")).alias("fits")).where("fits").select(*keep)


def hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """key, item_id: the verified pairs of texts and items."""
    hashed = lambda frame, name, column: frame.select(name, F.transform(words(F.col(column)), lambda w: F.xxhash64(w)).alias("hashes"))
    items = hashed(benchmark.where("item_id is not null").withColumn("item_id", F.col("item_id").cast("long")), "item_id", "text")
    texts, pair = hashed(docs, key, text), [key, "item_id"]
    # its size is checked, not assumed; WINDOW - 1 lengths at most
    short = F.when(F.size("hashes").between(1, WINDOW - 1), F.size("hashes"))
    size = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("words"), F.sort_array(F.collect_set(short)).alias("short"), F.count(short).alias("n_short")).first()
    seeds = _seeds(items, ["item_id"])
    if size.words * len(MASKS) * SEED_BYTES <= broadcast:
        marks = seeds.select("item_id", "seed", _near("hashes", "at").alias("theirs"), _place("at").alias("b"))
        some = _seeds(texts, [key]).join(F.broadcast(marks), "seed").select(*pair, _near("hashes", "at").alias("own"), "theirs", _place("at").alias("a"), "b")
    else:
        pairs = _seeds(texts, [key]).select(key, "at", "seed").join(seeds.select("item_id", F.col("at").alias("item_at"), "seed"), "seed").drop("seed")
        own = pairs.join(texts, key).select(*pair, "item_at", _near("hashes", "at").alias("own"), _place("at").alias("a"))
        some = own.join(items, "item_id").select(*pair, "own", "a", _near("hashes", "item_at").alias("theirs"), _place("item_at").alias("b"))
    found = _verified(some, pair)
    if size.short:
        few = size.n_short * SEED_BYTES <= broadcast
        found = found.unionByName(_whole(texts, items.where(F.size("hashes").between(1, WINDOW - 1)), pair, size.short, few)).distinct()
    return found


def _keyed(docs: DataFrame, text: str, name: str = _P + "key") -> DataFrame:
    return docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """All columns of ``docs`` and item_ids, the sorted items that a text overlaps with (empty: clean)."""
    key = free_name(docs, _P + "key")
    keyed = _keyed(docs, text, key)
    found = hits(keyed, benchmark, key, text, broadcast).groupBy(key).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = keyed.join(found, key, "left").drop(key)
    return out.withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<bigint>)")))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that overlap with no item; all their columns and no others."""
    key = free_name(docs, _P + "key")
    keyed = _keyed(docs, text, key)
    found = hits(keyed, benchmark, key, text).select(key).distinct()
    return keyed.join(found, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and items (ids with commas) of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = _keyed(plain, "text")
    found = hits(keyed, benchmark, _P + "key").groupBy(_P + "key").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    out = keyed.select("doc_id", _P + "key").join(found, _P + "key", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    n = F.when(F.col("ids").isNull(), F.lit(0)).otherwise(n)
    return out.select("doc_id", (n > 0).cast("int").alias("contaminated"), n.cast("long").alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"))


def oracle_cte(source: str = "documents", name: str = "found") -> str:
    """CTEs that end in ``name``: rid (of ``source``'s rows, which must have it) and item_id of verified overlaps."""
    cut = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    key = lambda m: "concat_ws(' ', " + ", ".join(f"w[a + {k + 1}]" for k, c in enumerate(m) if c == "1") + ")"
    seeds = lambda t: " UNION ALL ".join(f"SELECT id, a, {m} AS mask, {key(x)} AS seed FROM {t}, unnest(range(0, len(w) - {len(x) - 1})) u(a) WHERE len(w) >= {WINDOW}" for m, x in enumerate(MASKS))
    return f"""{name}_d AS MATERIALIZED (SELECT rid AS id, {cut} AS w FROM {source}),
{name}_b AS MATERIALIZED (SELECT item_id AS id, {cut} AS w FROM benchmark WHERE item_id IS NOT NULL),
{name}_x AS ({seeds(name + '_d')}), {name}_y AS ({seeds(name + '_b')}),
{name}_p AS (SELECT DISTINCT x.id AS d, y.id AS b, x.a - y.a AS s FROM {name}_x x JOIN {name}_y y USING (mask, seed)),
{name}_m AS (SELECT p.d, p.b, list_transform(range(greatest(0, -s), least(len(b.w), len(d.w) - s)), lambda i: CAST(d.w[i + s + 1] = b.w[i + 1] AS INT)) AS m
    FROM {name}_p p JOIN {name}_d d ON d.id = p.d JOIN {name}_b b ON b.id = p.b),
{name}_w AS (SELECT DISTINCT d.id AS rid, b.id AS item_id FROM (SELECT id, w, unnest(range(0, len(w))) AS a FROM {name}_d) d JOIN {name}_b b ON d.w[d.a + 1] = b.w[1]
    WHERE len(b.w) < {WINDOW} AND d.w[d.a + 1 : d.a + len(b.w)] = b.w),
{name} AS (SELECT rid, item_id FROM {name}_w UNION SELECT d AS rid, b AS item_id FROM {name}_m WHERE len(list_filter(range(1, len(m) - {WINDOW - 2}), lambda i: list_sum(m[i : i + {WINDOW - 1}]) >= {WINDOW - MISSES})) > 0)"""


def oracle() -> str:
    return f"""WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {oracle_cte("rows_")}
SELECT r.doc_id, CAST(count(f.item_id) > 0 AS INT) AS contaminated, count(f.item_id) AS n_items, coalesce(string_agg(CAST(f.item_id AS VARCHAR), ',' ORDER BY f.item_id), '') AS items
FROM rows_ r LEFT JOIN found f USING (rid) GROUP BY r.rid, r.doc_id"""
