"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs, in DataFrame functions only.

A text is the multiset of its lines. Each line is hashed to a wide vector, vectors are added, each lane modulo a power of
two, so order does not matter and a line can be inserted or deleted by adding or subtracting its vector (``combine``).
The vector of a line has two parts:
* 16 lanes of 32 bits, hashed from the line's SHA-256: they tell equal multisets from different ones;
* 120 one-bit lanes for each of its word pairs, summed in 31 bits each, which no text that a row can hold fills: lane sums,
  less half the number of pairs, are random projections of the multiset of pairs, so the cosine of two such parts estimates how
  much text two documents share. A text differs from its edited form within lines, so whole lines alone would tell less.

Null texts are empty. The next document is the next row by doc_id (nulls first), then text; after the last comes the first, so one row
follows itself. Repeated rows stay. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE_BITS, LANES_PER_SUM, SHIFTS = 31, 2, 30
LANES = 2 * LANES_PER_SUM * SHIFTS
MASK = sum(1 << (LANE_BITS * k) for k in range(LANES_PER_SUM))
WIDE = 16
SUMS = [f"s{k}" for k in range(2 * SHIFTS)]


def pair_hashes(text: Column) -> Column:
    """A hash for each word with the one after it in its line."""
    line = lambda p: F.flatten(F.transform(F.array(F.split(p, " ")), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))))
    return F.flatten(F.transform(F.split(text, "\n"), line))


def wide_lanes(text: Column) -> Column:
    """The sums of all lines' lanes, each modulo 2**32."""
    mod = F.lit(2**32 - 1)
    digests = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))
    none = F.array(*[F.lit(0).cast("long")] * WIDE)
    vector = lambda d: F.array(*[F.xxhash64(d, F.lit(k)).bitwiseAND(mod) for k in range(WIDE)])
    return F.aggregate(F.transform(digests, vector), none, lambda a, v: F.zip_with(a, v, lambda x, y: (x + y).bitwiseAND(mod)))


def lanes(sums: Column) -> Column:
    """The single lanes of an array of packed sums."""
    return F.flatten(F.transform(sums, lambda s: F.array(*[F.shiftright(s, LANE_BITS * k).bitwiseAND(F.lit(2**LANE_BITS - 1)) for k in range(LANES_PER_SUM)])))


def hexed(wide: Column, sums: Column, n: Column) -> Column:
    return F.concat(
        F.array_join(F.transform(wide, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
        F.lit("-"),
        F.lower(F.hex(n)),
        F.lit("-"),
        F.array_join(F.transform(sums, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""),
    )


def likeness(a: Column, an: Column, b: Column, bn: Column) -> Column:
    """Cosine of the projections of two texts, 0 to 1; 1 for equal ones."""
    centred = lambda s, n: F.transform(lanes(s), lambda v: 2.0 * v - n)
    x, y = centred(a, an), centred(b, bn)
    dot = F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    square = lambda z: F.aggregate(z, F.lit(0.0), lambda t, v: t + v * v)
    norm = F.sqrt(square(x)) * F.sqrt(square(y))
    return F.when((a == b) & (an == bn), 1.0).otherwise(F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(0.0))


def combine(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """(id, n, wide, sums) of a with the lines of b inserted (sign 1) or deleted (-1), without the texts."""
    both = a.select("id", "n", "wide", "sums").join(b.select("id", F.col("n").alias("n2"), F.col("wide").alias("wide2"), F.col("sums").alias("sums2")), "id")
    mod = F.lit(2**32 - 1)
    return both.select("id", (F.col("n") + sign * F.col("n2")).alias("n"), F.zip_with("wide", "wide2", lambda x, y: (x + sign * y).bitwiseAND(mod)).alias("wide"), F.zip_with("sums", "sums2", lambda x, y: x + sign * y).alias("sums"))


def fingerprints(texts: DataFrame, keys: list[str], first: list[str] = ()) -> DataFrame:
    """texts: keys, which tell each row from others, text, and columns to carry (first). Adds n, wide, sums. The row's lines are read once for the wide lanes; its word pairs become rows that are summed before any exchange."""
    read = texts.select(*keys, *first, wide_lanes(F.col("text")).alias("wide"), "text")
    pairs = read.select(*keys, *first, "wide", F.explode(pair_hashes(F.col("text"))).alias("h"))
    second = pairs.withColumn("g", F.xxhash64("h"))
    sums = [F.try_sum(F.shiftright(c, k).bitwiseAND(F.lit(MASK))).alias(SUMS[i * SHIFTS + k]) for i, c in enumerate(("h", "g")) for k in range(SHIFTS)]
    made = second.groupBy(*keys, *first, "wide").agg(F.count("*").alias("n"), *sums)
    return made.select(*keys, *first, "n", "wide", F.array(*[F.coalesce(s, F.lit(0).cast("long")) for s in SUMS]).alias("sums"))


def bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the documents into ranges of about as many rows; the least id is none of them."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    low = ids.agg(F.min("doc_id")).first()[0]
    found = F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets)
    cuts = ids.agg(found).first()[0] or []
    return sorted({int(x) for x in cuts if x != low})


def with_next(docs: DataFrame, rows_per_bucket: int = 2000) -> DataFrame:
    """bucket, rn, doc_id, text and next_text. One exchange by ranges of doc_id; each range also gets a copy of the row that begins the next one."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    buckets = int(min(20_000, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_bucket + 1, 2)))
    cuts = bounds(docs, buckets)
    array = F.array(*map(F.lit, cuts)).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    # the place of doc_id among the cuts, by halving
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_place(F.col("doc_id"), array, len(cuts)))
    own = docs.select(bucket.cast("int").alias("bucket"), F.lit(0).alias("ghost"), "doc_id", "text")
    low = docs.where(F.col("doc_id").isNull()).limit(1).count()
    least = None if low or not n else docs.agg(F.min("doc_id")).first()[0]
    starts = [(c, k) for k, c in enumerate(cuts)] + ([(least, len(cuts))] if n else [])
    if not starts:
        starts = [(0, 0)]
    begin = spark.createDataFrame(starts, "b_id long, bucket int")  # one row for each range, 20,000 at most
    ghosts = docs.join(F.broadcast(begin), F.col("doc_id").eqNullSafe(F.col("b_id"))).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    ghosts = ghosts.select("bucket", F.lit(1).alias("ghost"), "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text")
    both = own.unionByName(ghosts)
    return both.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def _place(x: Column, cuts: Column, n: int) -> Column:
    """How many cuts are x or less: a search by halving, written out as steps."""

    def ahead(at: Column, step: int) -> Column:
        return F.transform(F.array(at), lambda a: F.when((a + step <= n) & (F.get(cuts, a + step - 1) <= x), a + step).otherwise(a))[0]

    at = F.lit(0)
    for k in range(n.bit_length() - 1, -1, -1):
        at = ahead(at, 1 << k)
    return at


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """The digest columns: every text, the same with its last quarter replaced by the next text's beginning, and both fingerprints compared."""
    rows = with_next(docs)
    size = F.length("text")
    keep = size - F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), keep), F.substring("next_text", F.lit(1), F.floor(size / 4).cast("int")))
    texts = rows.select("bucket", "rn", "ghost", "doc_id", size.cast("long").alias("n_chars"), F.col("text").alias("t"), F.coalesce(edited, F.col("text")).alias("e"))
    two = F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("e").alias("text"), F.sha2("e", 256).alias("sha")))
    each = texts.select("bucket", "rn", "ghost", "doc_id", "n_chars", F.explode(two).alias("x")).where("ghost = 0 OR x.kind = 0")
    each = each.select("bucket", "rn", "ghost", "doc_id", "n_chars", "x.kind", "x.text", "x.sha")
    made = fingerprints(each, ["bucket", "rn", "kind"], ["ghost", "doc_id", "n_chars", "sha"])
    order = Window.partitionBy("bucket").orderBy("rn", "kind")
    fp = F.struct("wide", "sums", "n")
    near = made.select(
        "bucket", "ghost", "doc_id", "n_chars", "kind", fp.alias("own"),
        F.lead("sha").over(order).alias("edited_sha256"), F.lead(fp).over(order).alias("edited"), F.lead(fp, 2).over(order).alias("next"),
    ).where("ghost = 0 AND kind = 0")
    own, edit, after = (F.col(x) for x in ("own", "edited", "next"))
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(own["wide"], own["sums"], own["n"]).alias("fingerprint"),
        hexed(edit["wide"], edit["sums"], edit["n"]).alias("edited_fingerprint"),
        likeness(own["sums"], own["n"], edit["sums"], edit["n"]).alias("near_edited"),
        likeness(own["sums"], own["n"], after["sums"], after["n"]).alias("near_next"),
    )
