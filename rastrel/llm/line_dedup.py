"""Removal of repeated multi-line chunks, with DataFrame functions alone.

Lines are hashed, and a rolling hash over ``WINDOW`` neighbouring lines chooses
boundaries where it is no greater than before or after, so that a boundary
depends on the lines around it and not on what stands before them, and of any
two neighbouring places one is chosen. A chunk is the lines that the hash at a
boundary covers; chunks overlap, and repeated ones that follow each other go as
one run. Chunks are grouped by their bytes; every occurrence but the first, by
(doc_id, place), is removed.

So of any passage of three lines or more that repeats, whatever stands around
it, all lines are found but perhaps its first and last one, which may belong to
a boundary outside.

Digests tell which chunks may repeat. Only those chunks' texts are shuffled, after
copies of a task have been added up, and only digests come back to the
occurrences, so a chunk that a third of the documents share is no large group
anywhere. Documents are dealt once, for both looks at their texts.

Defined cases: a null text is empty and stays null; an empty one has one empty
line and, as any text of one line, no chunk; a null ``doc_id`` comes before
others; rows with equal ``doc_id`` and text are one document and are cut alike;
all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that the rolling hash covers, which are a chunk.
WINDOW = 2


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, which any SQL engine has."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _boundaries(rolls: Column) -> Column:
    """Places whose rolling hash is no greater than one beside it; the ends have none there."""
    place = lambda k: (F.get(rolls, k) <= F.get(rolls, k - 1)) | (F.get(rolls, k) <= F.get(rolls, k + 1)) | (k == 0) | (k == F.size(rolls) - 1)
    return F.filter(F.sequence(F.lit(0), F.size(rolls) - 1), place)


def _key(body: Column) -> list[Column]:
    """digest and size: 16 bytes and the length of a chunk's text. Never null, so that joins add no filter."""
    return [_md5(body).alias("digest"), F.length(body).alias("size")]


def _md5(text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def _body(lines: Column, k: Column) -> Column:
    return F.array_join(F.slice(lines, k + 1, WINDOW), "\n")


def _chunks(docs: DataFrame) -> DataFrame:
    """d (the document), k (the chunk's place in it), digest, size: a row for each chunk."""
    cut = docs.select("d", _lines(F.col("text")).alias("lines")).select("*", F.transform("lines", line_hash).alias("hashes"))
    rolling = lambda k: sum((F.get("hashes", k + j) * F.lit(31 ** (WINDOW - 1 - j)) for j in range(1, WINDOW)), F.get("hashes", k) * F.lit(31 ** (WINDOW - 1)))
    rolls = F.when(F.size("lines") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), rolling))
    cut = cut.select("d", "lines", rolls.alias("rolls")).where("rolls is not null")
    each = F.transform(_boundaries(F.col("rolls")), lambda k: F.struct(k.alias("k"), _body(F.col("lines"), k).alias("body")))
    return cut.select("d", F.explode(each).alias("c")).select("d", "c.k", *_key(F.col("c.body")))


def _places(chunks: DataFrame, out: str) -> DataFrame:
    """e (a document) and the places of its chunks."""
    return chunks.groupBy(F.col("d").alias("e")).agg(F.collect_set("k").alias(out))


def _cut(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns of docs under other names, new (the text cut), n_lines, n_removed and n_chunks; and those names."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")
    d = F.concat(name, _md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    whole = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), d.alias("d"))
    string = F.col(names[text]).cast("string")

    # digests say which chunks may repeat; only the bytes of those are brought together
    each = _chunks(whole.select("d", string.alias("text")))
    often = each.groupBy("digest", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    near = whole.join(_places(each.join(often, ["digest", "size"]), "ks"), F.col("d") == F.col("e"))
    near = near.select(F.col(names["doc_id"]).cast("long").alias("i"), "d", _lines(string).alias("lines"), "ks")
    bodies = near.select("i", "d", F.explode(F.transform("ks", lambda k: F.struct(k.alias("k"), _body(F.col("lines"), k).alias("body")))).alias("c"))
    same = bodies.select(F.struct("i", "d", "c.k").alias("place"), "c.body").groupBy("body").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    again = each.join(same.select(*_key(F.col("body")), "first"), ["digest", "size"]).where((F.col("d") != F.col("first.d")) | (F.col("k") != F.col("first.k")))

    # the texts are cut again here rather than carried cut through the shuffle
    both = whole.join(_places(again, "gone"), F.col("d") == F.col("e"), "left")
    removed = F.array_distinct(F.flatten(F.transform("gone", lambda k: F.sequence(k, k + WINDOW - 1))))
    cut = both.select(*names.values(), _lines(string).alias("lines"), "gone", removed.alias("removed"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    new = F.when(F.col("gone").isNull(), F.col(names[text])).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    count = lambda c: F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return cut.select(*names.values(), new.alias("new"), F.size("lines").cast("long").alias("n_lines"), count("removed").alias("n_removed"), count("gone").alias("n_chunks")), names


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and n_lines, n_removed (lines) and n_chunks (removed ones)."""
    cut, names = _cut(docs, text)
    return cut.select(*((F.col("new") if c == text else F.col(n)).alias(c) for c, n in names.items()), "n_lines", "n_removed", "n_chunks")


def clean(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """All columns of ``docs`` and no others, with ``text`` cut and ``size`` (if there is one) following it.

    A document of which no line is left repeats others as a whole and goes.
    """
    cut, names = _cut(docs, text)
    cut = cut.where((F.col("n_chunks") == 0) | (F.col("n_removed") < F.col("n_lines")))
    kind = dict(docs.dtypes).get(size)
    value = {text: F.col("new")}
    if kind:
        value[size] = F.when(F.col("n_chunks") > 0, F.length("new").cast(kind)).otherwise(F.col(names[size]))
    return cut.select(*(value.get(c, F.col(n)).alias(c) for c, n in names.items()))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks, n_kept (characters) and kept_sha256 of every document."""
    out = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", F.length(text).cast("long").alias("n_kept"), F.sha2(text, 256).alias("kept_sha256"))


def oracle_cte(source: str = "documents", name: str = "deduped") -> str:
    """CTEs that end in ``name``: the columns of ``source`` (doc_id, text, lang, source, n_chars) with the text cut, n_lines, n_removed, n_chunks."""
    return f"""{name}_l AS (SELECT row_number() OVER () AS rid, *, string_split(coalesce(text, ''), chr(10)) AS l FROM {source}),
{name}_h AS (SELECT *, list_transform(l, lambda x: CAST('0x' || md5(x)[1:8] AS BIGINT)) AS h FROM {name}_l),
{name}_r AS (SELECT *, list_transform(range(1, len(l)), lambda i: h[i] * 31 + h[i + 1]) AS r FROM {name}_h),
{name}_k AS (SELECT *, unnest(range(1, len(l))) AS k FROM {name}_r),
{name}_c AS (SELECT rid, doc_id, coalesce(text, '') AS whole, k, l[k] || chr(10) || l[k + 1] AS body FROM {name}_k WHERE k = 1 OR k = len(r) OR r[k] <= r[k - 1] OR r[k] <= r[k + 1]),
{name}_g AS (SELECT rid, k FROM (SELECT rid, k, dense_rank() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, md5(whole), k) AS n FROM {name}_c) WHERE n > 1),
{name}_x AS (SELECT DISTINCT rid, unnest([k, k + 1]) AS k FROM {name}_g),
{name}_y AS (SELECT rid, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM {name}_l),
{name}_s AS (SELECT y.rid, coalesce(string_agg(line, chr(10) ORDER BY y.k) FILTER (WHERE x.rid IS NULL), '') AS kept, count(*) AS n_lines, count(x.rid) AS n_removed FROM {name}_y y LEFT JOIN {name}_x x ON x.rid = y.rid AND x.k = y.k GROUP BY y.rid),
{name}_n AS (SELECT rid, count(*) AS n_chunks FROM {name}_g GROUP BY rid),
{name} AS (SELECT d.* EXCLUDE (rid, l, text), CASE WHEN s.n_removed = 0 THEN d.text ELSE s.kept END AS text, s.n_lines, s.n_removed, coalesce(n.n_chunks, 0) AS n_chunks FROM {name}_l d JOIN {name}_s s USING (rid) LEFT JOIN {name}_n n USING (rid))"""


def oracle() -> str:
    return f"WITH {oracle_cte()}\nSELECT doc_id, n_lines, n_removed, n_chunks, CAST(length(coalesce(text, '')) AS BIGINT) AS n_kept, sha256(coalesce(text, '')) AS kept_sha256 FROM deduped"
