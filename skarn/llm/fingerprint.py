"""Document fingerprints by one-permutation MinHash, native.

The five-word shingles of a text are hashed once; the top bits of a hash choose one of ``BINS``
bins and the least hash of each bin is kept.  An empty bin is filled by optimal densification: it
takes the value of the first non-empty bin of its own fixed pseudo-random probing order.  The low
eight bits of every bin are stored, two hex digits each, and the likeness of two fingerprints is the
share of equal bins corrected for chance: ``(m - 1/256) / (1 - 1/256)``.

Words are lower-cased (A-Z) runs of anything but white space.  Fewer than five words are one shingle,
their sequence; a text without words is one fixed shingle.

Defined cases: null text is empty; equal texts have equal fingerprints; ``with_next`` orders rows by
descending id, then text (repeated rows are each other's neighbours); a single row is its own next;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.text import words_column

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 63 - BIN_BITS
STORED_BITS = 8
SLABS = 64  # least number of id ranges that neighbours are found in


def _probing_orders() -> list[list[int]]:
    """For each bin a fixed permutation of all bins: multiplicative steps from a mixed start."""
    orders = []
    for j in range(BINS):
        x = ((j + 1) * 0x9E3779B1) & 0xFFFFFFFF
        keys = []
        for k in range(BINS):
            x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
            keys.append((x ^ (x >> 15), k))
        orders.append([k for _, k in sorted(keys) if k != j])
    return orders


def shingle_hashes(words: Column) -> Column:
    """Non-negative hashes of the shingles: word hashes are joined two by two, then once more."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    tail = lambda x, by, less: F.slice(x, by + 1, F.greatest(n - less, F.lit(0)))
    head = lambda x, less: F.slice(x, 1, F.greatest(n - less, F.lit(0)))
    two = F.zip_with(head(h, 1), tail(h, 1, 1), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(head(two, 3), tail(two, 2, 3), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(head(four, 4), tail(h, 4, 4), lambda a, b: F.shiftrightunsigned(F.xxhash64(a, b), 1))
    return F.when(n >= WORDS, five).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", words)), 1)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the hex fingerprint of a text column."""
    keep = df.columns
    top = (1 << VALUE_BITS) - 1
    sentinels = F.array(*[F.lit((b << VALUE_BITS) | top).cast("bigint") for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, VALUE_BITS)
    df = df.withColumn("_words", words_column(F.col(text)))
    df = df.withColumn("_sorted", F.sort_array(F.concat(shingle_hashes(F.col("_words")), sentinels)))
    least = F.zip_with("_sorted", F.concat(F.array(F.lit(-1).cast("bigint")), "_sorted"), lambda x, p: F.when(p.isNull() | (bin_of(x) != bin_of(p)) | (p < 0), x))
    df = df.withColumn("_least", F.filter(least, lambda x: x.isNotNull()))
    df = df.withColumn("_value", F.transform("_least", lambda x: F.when(x.bitwiseAND(top) != top, x.bitwiseAND((1 << STORED_BITS) - 1).cast("int"))))
    orders = F.array(*[F.array(*map(F.lit, o)) for o in _probing_orders()])
    probed = F.transform("_value", lambda v, j: F.when(v.isNotNull(), v).otherwise(F.element_at(F.filter(F.transform(F.element_at(orders, j + 1), lambda k: F.get(F.col("_value"), k)), lambda x: x.isNotNull()), 1)))
    full = F.when(F.exists("_value", lambda v: v.isNull()), probed).otherwise(F.col("_value"))
    return df.select(*keep, F.array_join(F.transform(full, lambda v: F.substring(F.hex(v + 256), 2, 2)), "").alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts of two fingerprints."""
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2))))
    chance = 2.0**-STORED_BITS
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def with_next(df: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> from the row that follows in descending order of the id (after the last,
    the first).

    Ids are cut into ranges of about equal row counts, two for each shuffle partition and ``SLABS`` at
    least; each range is one window, and the
    first row of the following range is put at its end, so no window holds all rows and the
    texts are shuffled once."""
    slabs = max(SLABS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.col(doc_id).cast("double")
    bounds = sorted(set(df.select(at.alias("x")).approxQuantile("x", [i / slabs for i in range(1, slabs)], 0.1 / slabs)))
    # two steps, so that a row is compared with about the root of the number of bounds
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    above = lambda x: F.size(F.filter(x, lambda b: at > b))
    slab = F.lit(1)
    if groups:
        placed = df.withColumn("_group", above(F.array(*[F.lit(g[-1]) for g in groups])))
        fine = F.coalesce(above(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.col("_group"))), F.lit(0))
        slab = F.col("_group") * step + fine + 1
    else:
        placed = df.withColumn("_group", F.lit(0))
    placed = placed.withColumn("_slab", F.when(F.col(doc_id).isNull(), F.lit(0)).otherwise(slab))
    tops = sorted(((r[0], r[1]) for r in placed.groupBy("_slab").agg(F.max(doc_id)).collect()), reverse=True)
    guest_of = [None] * (len(bounds) + step + 3)
    top_of = list(guest_of)
    for (into, _), (own, first) in zip(tops, tops[1:] + tops[:1], strict=True):
        guest_of[own], top_of[own] = into, first
    home = lambda x, guest: F.struct(x.alias("slab"), F.lit(guest).alias("guest"))
    array_of = lambda x, kind: F.array(*[F.lit(v).cast(kind) for v in x])
    into = F.get(array_of(guest_of, "int"), F.col("_slab"))
    is_top = F.get(array_of(top_of, "bigint"), F.col("_slab")).eqNullSafe(F.col(doc_id))
    homes = F.array(home(F.col("_slab"), False))
    spread = placed.withColumn("_at", F.explode(F.when(is_top, F.concat(homes, F.array(home(into, True)))).otherwise(homes))).withColumns({"_home": F.col("_at.slab"), "_guest": F.col("_at.guest")})
    w = Window.partitionBy("_home").orderBy("_guest", F.desc_nulls_last(doc_id), *columns)
    led = spread.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return led.where(~F.col("_guest")).drop("_group", "_slab", "_at", "_home", "_guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the following text's start."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - k).cast("int")), F.substring(following, F.lit(1), k))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(slim, "text", "fingerprint")
    pairs = with_next(own, "doc_id", ["text", "fingerprint"])
    pairs = pairs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint", edited(F.col("text"), F.col("next_text")).alias("edited"))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_fingerprint(pairs, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
