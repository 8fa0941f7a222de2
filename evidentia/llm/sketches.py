"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction (1 / ``FRACTION``) of the hash range, and no other,
whatever the document's length. So sketches of one fraction can be compared between very unequal documents: the
share of a's hashes that b has estimates how much of a stands in b, however long b is; and the union of sketches
is the sketch of the documents together.

Shingles are ``WORDS`` words (runs between ASCII white space, as they are written) joined by spaces; a shorter text
is one shingle. A hash is the first 64 bits of the shingle's MD5, as 16 hexadecimal digits, whose order is that of
the numbers. Everything is DataFrame functions; each text is hashed once for each use.

The next document, by ascending doc_id, comes by one exchange: rows go to buckets of doc_id ranges, and the first
rows of a bucket are sent to the bucket before it too. The buckets are cut at quantiles of doc_id, one for each
``ROWS`` rows and at most ``MAX_CUTS``, so a few outlying ids make no large bucket; larger tables get larger
buckets, which are sorted and read in order, not held. Where one doc_id fills several quantiles its rows are cut
by a hash of their text.

Values: a null text is empty. A text without a hash below the fraction has the empty sketch: two such texts are
alike (1) if they are equal, else not (0), and containment in such a text's terms is null. A null doc_id comes
first. Rows with one doc_id follow each other by their text (by its hash where one doc_id fills several quantiles).
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import NO_ID, text_of

WORDS = 5
FRACTION = 8
ROWS = 256
MAX_CUTS = 4096
#: Cuts that are looked through at once.
_GROUP = 64
_SPACE = r"[ \t\n\x0B\f\r]+"


def below(fraction: int) -> str:
    """What a kept hash is less than."""
    return f"{(1 << 64) // fraction:016x}" if fraction > 1 else "g"


def shingle_hashes(words: Column, width: int = WORDS) -> Column:
    """Of an array of words: the hash of each run of so many, of all of them if they are fewer, none if there are none."""
    hashed = lambda c: F.substring(F.md5(c.cast("binary")), 1, 16)
    rolled = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: hashed(F.concat_ws(" ", *[words[i + j] for j in range(width)])))
    return F.when(F.size(words) >= width, rolled).when(F.size(words) > 0, F.array(hashed(F.array_join(words, " ")))).otherwise(words)


def with_sketches(df: DataFrame, texts: dict[str, str], width: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """Adds, for each text column, the named column of its sketch: sorted distinct hashes.

    In steps, so that no array is computed again for each place that reads it.
    """
    df = df.withColumns({out: F.filter(F.split(F.col(column), _SPACE), lambda w: w != "") for column, out in texts.items()})
    df = df.withColumns({out: shingle_hashes(F.col(out), width) for out in texts.values()})
    return df.withColumns({out: F.sort_array(F.array_distinct(F.filter(out, lambda h: h < below(fraction)))) for out in texts.values()})


def digest(kept: Column) -> Column:
    return F.array_join(kept, ",")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together, but for shingles that span them."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard coefficient that two sketches estimate; null for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; null for an empty sketch a, which tells nothing."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def _numbers(values: list[int], kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _bucketed(base: DataFrame, rows: int) -> DataFrame:
    """Adds ``bucket``, which ascends with (id, h, text), and h: a hash of the text where one id fills buckets, else 0."""
    found = base.agg(F.count("*").alias("n")).first()["n"]
    number = max(1, min(MAX_CUTS, found // rows))
    cuts = base.agg(F.percentile_approx("id", [i / number for i in range(1, number)], 10_000).alias("c")).first()["c"] if number > 1 else []
    often = {c: (cuts or []).count(c) for c in {*(cuts or [])}} if len(set(cuts or [])) < len(cuts or []) else dict.fromkeys(cuts or [], 1)
    low = [NO_ID, *sorted(c for c in often if c > NO_ID)]
    times = [often.get(c, 1) for c in low]
    begins = [0, *accumulate(t + 1 if t > 1 else 1 for t in times)][: len(low)]
    groups = [low[i : i + _GROUP] for i in range(0, len(low), _GROUP)]
    heads = _numbers([g[0] for g in groups], "bigint")
    within = F.array(*[_numbers(g, "bigint") for g in groups])
    df = base.withColumn("group", F.size(F.filter(heads, lambda c: c <= F.col("id"))))
    df = df.withColumn("segment", (F.col("group") - 1) * _GROUP + F.size(F.filter(F.element_at(within, F.col("group")), lambda c: c <= F.col("id"))))
    begin = F.element_at(_numbers(begins, "bigint"), F.col("segment"))
    if max(times) == 1:
        return df.select(*base.columns, F.lit(0).cast("long").alias("h"), begin.alias("bucket"))
    share, cut = F.element_at(_numbers(times, "bigint"), F.col("segment")), F.element_at(_numbers(low, "bigint"), F.col("segment"))
    heavy = (share > 1) & (F.col("id") == cut)
    place = F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * share)
    inside = F.when(heavy, F.least(share - 1, place)).when(share > 1, share).otherwise(0)
    return df.select(*base.columns, F.when(heavy, F.xxhash64("text")).otherwise(0).alias("h"), (begin + inside).alias("bucket"))


def _with_next(docs: DataFrame, rows: int) -> tuple[DataFrame, Window]:
    """The documents and, as guests, the first of the bucket behind; the window that orders a bucket."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = _bucketed(base, rows)
    # two rows of a few numbers for each of at most MAX_CUTS quantiles
    order = Window.orderBy("bucket")
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("first")).withColumn("before", F.lag("bucket").over(order))
    last = dealt.agg(F.max("bucket").alias("last_bucket"))
    firsts = firsts.join(F.broadcast(last)).select("bucket", "first", F.coalesce("before", "last_bucket").alias("before"), F.col("before").isNull().alias("wraps"))
    joined = dealt.join(F.broadcast(firsts), "bucket")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("guest"))
    places = F.when((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")), F.array(own, guest)).otherwise(F.array(own))
    spread = joined.select("id", "h", "doc_id", "text", F.explode(places).alias("at")).select("id", "h", "doc_id", "text", "at.bucket", "at.guest")
    return spread, Window.partitionBy("bucket").orderBy("guest", "id", "h", "text")


def fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per document: its sketch, that of the text whose second half is the next document's start, and the likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spread, order = _with_next(docs, rows)
    followed = spread.withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    followed = followed.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    followed = followed.select("id", "h", "doc_id", "bucket", "guest", "n_chars", "text", F.coalesce("edited", F.lit("")).alias("edited"))
    kept = with_sketches(followed, {"text": "kept", "edited": "edited_kept"})
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    kept = kept.select("id", "h", "doc_id", "bucket", "guest", "n_chars", "text", sha("text").alias("sha"), sha("edited").alias("edited_sha256"), "kept", "edited_kept")
    # the same buckets in the same order: no exchange, no sort
    kept = kept.withColumns({"next_kept": F.lead("kept").over(order), "next_sha": F.lead("sha").over(order)}).filter("guest = 0")
    near = lambda other, same: F.coalesce(likeness(F.col("kept"), F.col(other)), (F.col("sha") == F.col(same)).cast("double"))
    return kept.select("doc_id", "n_chars", "edited_sha256", digest(F.col("kept")).alias("fingerprint"), digest(F.col("edited_kept")).alias("edited_fingerprint"), near("edited_kept", "edited_sha256").alias("near_edited"), near("next_kept", "next_sha").alias("near_next"))


def _sketch_sql(text: str) -> str:
    words = f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda w: w <> '')"
    rolled = f"list_transform(CASE WHEN len(x) >= {WORDS} THEN range(1, len(x) - {WORDS} + 2) WHEN len(x) > 0 THEN [1] ELSE [] END, lambda i: substr(md5(array_to_string(x[i : i + {WORDS - 1}], ' ')), 1, 16))"
    return f"(SELECT list_sort(list_distinct(list_filter({rolled}, lambda h: h < '{below(FRACTION)}'))) FROM (SELECT {words} AS x))"


def _near_sql(a: str, b: str, same: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN CAST(({same}) AS DOUBLE) ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"


#: DuckDB SQL of ``fingerprints``.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
f AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM f),
s AS (SELECT doc_id, n, text, nxt, edited, {_sketch_sql('text')} AS a, {_sketch_sql('edited')} AS b, {_sketch_sql('nxt')} AS c FROM e)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
 {_near_sql('a', 'b', 'text = edited')} AS near_edited, {_near_sql('a', 'c', 'text = nxt')} AS near_next FROM s
"""
