"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers (pairs of neighbouring words; a lone word is one) are numbered by occurrence, so that repeats count. A hash
of k-mer and number deals them to BINS bins; of each bin the two least hashes are selected. A bin of fewer takes what it lacks from the other bins,
which it tries in an order of its own (densification), so that in short texts, too, every bin selects two of all k-mers, independently of the others.
The two are put back in the order of the text and hashed as a tuple: a bin agrees between two texts only if the same k-mers are selected and stand in the
same order, which follows the edit distance rather than the mere sets. The likeness is the share of agreeing bins.

All of it happens within a row, by sorting packed longs: no k-mer is exploded and nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 6
BINS = 1 << BIN_BITS
#: Bits of a packed long that hold a k-mer's place: a string has fewer words than that.
PLACE_BITS = 30
HASH_BITS = 63 - PLACE_BITS
#: About so many rows of neighbouring ids find their successor in one task, and so many of such groups theirs.
GROUP_ROWS, TOP_BITS = 64, 13


def low_bits(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def kmer_hashes(words: Column) -> Column:
    """Packed (hash, place) of each word with the word behind it (the last: with nothing), sorted."""

    def packed(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, F.coalesce(F.get(words, i + 1), F.lit("")))
        return F.shiftleft(low_bits(h, HASH_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    return F.sort_array(F.transform(words, packed))


def numbered(kmers: Column) -> Column:
    """Packed (bin, hash, place) of each k-mer with its occurrence number, sorted. The first occurrence keeps the k-mer's own hash.

    kmers is sorted, so the number is how far back the same hash reaches: none for most, else found bit by bit."""
    high = lambda x: F.shiftright(x, PLACE_BITS)
    same = lambda x, i, n: (i >= n) & (high(F.get(kmers, i - n)) == high(x))
    power = lambda b: F.call_function("shiftleft", F.lit(1), b)

    def occurrence(x: Column, i: Column) -> Column:
        bits = F.sequence(F.floor(F.log2(F.size(kmers).cast("double"))).cast("int"), F.lit(0), F.lit(-1))
        reach = F.aggregate(bits, F.lit(0), lambda n, b: F.when(same(x, i, n + power(b)), n + power(b)).otherwise(n))
        return F.coalesce(reach, F.lit(0))

    def packed(x: Column, i: Column) -> Column:
        again = low_bits(F.xxhash64(high(x), occurrence(x, i)), HASH_BITS)
        return F.when(same(x, i, F.lit(1)), F.shiftleft(again, PLACE_BITS).bitwiseOR(low_bits(x, PLACE_BITS))).otherwise(x)

    return F.sort_array(F.transform(kmers, packed))


def bin_of(x: Column) -> Column:
    return F.shiftright(x, 63 - BIN_BITS)


def selected(rows: Column) -> Column:
    """The two least hashes of each bin, in the order of bins."""
    return F.filter(rows, lambda x, i: (i < 2) | (bin_of(F.get(rows, F.greatest(i - 2, F.lit(0)))) != bin_of(x)))


def tuple_of(j: Column, x: Column, other: Column) -> Column:
    """Packed (bin, hash of 32 bits) of two selected k-mers, in the order of the text; other may be null."""
    swap = low_bits(x, PLACE_BITS) > low_bits(other, PLACE_BITS)
    a, z = F.shiftright(x, PLACE_BITS), F.shiftright(other, PLACE_BITS)
    both = F.when(swap, F.xxhash64(z, a)).otherwise(F.xxhash64(a, z))
    return F.shiftleft(j.cast("long"), 32).bitwiseOR(low_bits(both, 32))


def signature(least: Column) -> Column:
    """tuple_of each bin: of its own two k-mers, or, if it has fewer, filled up from the other bins in the bin's own order of them."""

    def whole(x: Column, i: Column) -> Column:
        after = F.get(least, i + 1)
        head = (i == 0) | (bin_of(F.get(least, F.greatest(i - 1, F.lit(0)))) != bin_of(x))
        return F.when(head & (bin_of(after) == bin_of(x)), tuple_of(bin_of(x), x, after))

    full = F.array_compact(F.transform(least, whole))

    def filled(j: Column) -> Column:
        turn = lambda x: F.when(bin_of(x) == j, F.lit(0).cast("long")).otherwise(1 + low_bits(F.xxhash64(j, bin_of(x)), 40))
        keys = F.array(F.transform(least, lambda x, i: F.shiftleft(turn(x), BIN_BITS + 1).bitwiseOR(i.cast("long"))))
        two = F.transform(keys, lambda t: F.struct(F.array_min(t).alias("a"), F.array_min(F.filter(t, lambda v: v > F.array_min(t))).alias("b")))
        at = lambda v: F.get(least, low_bits(v, BIN_BITS + 1).cast("int"))
        return F.transform(two, lambda p: tuple_of(j, at(p["a"]), at(p["b"])))[0]

    lacking = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), F.transform(full, lambda x: F.shiftright(x, 32)))
    return F.when(F.size(least) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.concat(full, F.transform(lacking, filled))))


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the column `name`: array<long>. Runs of ASCII white space separate words; a text without words has none."""
    w, k, n, s = (f"__{x}_{name}" for x in "wkns")
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    df = df.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")))
    df = df.withColumn(k, kmer_hashes(F.col(w))).withColumn(n, F.when(F.size(k) > 0, numbered(F.col(k))).otherwise(F.col(k)))
    return df.withColumn(s, selected(F.col(n))).withColumn(name, signature(F.col(s))).drop(w, k, n, s)


def fingerprint(signature: Column) -> Column:
    """The signature as hexadecimal text: two digits for the bin and eight for its hash, of each bin that has k-mers."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins that agree; 1 if neither side has any k-mer, 0 if one has none."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, signature, and next_text and next_signature of the next row in descending doc_id (after the last: the first).

    Rows are dealt to groups of neighbouring ids, of about GROUP_ROWS rows by the range of ids, however dense they are; a group's rows find their successor
    by a window. Only each group's last row needs the head of the group behind, found over one row a group, in two levels. The three readers of the
    windowed rows share one shuffle. Null ids come last, in the order of a hash of their texts, which deals them to groups alike; rows of one id are ordered by text.
    """
    seen = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bits = lambda span, n: max(0, math.floor(math.log2(max(1.0, span * GROUP_ROWS / max(1, n)))))
    shift, null_shift = bits(float(seen.high or 0) - float(seen.low or 0), seen.n), min(63, bits(2.0**64, seen.nulls))
    last = F.col("doc_id").isNull()
    at = F.when(last, F.xxhash64("text")).otherwise(F.bitwise_not("doc_id"))
    docs = docs.select("doc_id", "text", "signature", last.alias("last"), at.alias("at")).withColumn("g", F.when(F.col("last"), F.shiftright("at", null_shift)).otherwise(F.shiftright("at", min(63, shift))))
    within = Window.partitionBy("last", "g").orderBy("at", F.col("text").asc_nulls_first(), "doc_id")  # all columns, so that all readers share one shuffle
    rows = docs.select("*", *(F.lead(c).over(within).alias(f"next_{c}") for c in ("text", "signature")), F.lag(F.lit(True)).over(within).isNull().alias("head"))
    heads = rows.where("head").select(F.struct("last", "g").alias("to"), F.col("text").alias("head_text"), F.col("signature").alias("head_signature"))
    groups = docs.select("last", "g").distinct().select(F.struct("last", "g").alias("k"), F.struct("last", F.shiftright("g", TOP_BITS).alias("t")).alias("top"))
    tops = groups.groupBy("top").agg(F.min("k").alias("head"))
    tops = tops.select("top", F.coalesce(F.lead("head").over(Window.orderBy("top")), F.min("head").over(Window.partitionBy())).alias("below"))
    down = F.lead("k").over(Window.partitionBy("top").orderBy("k"))
    groups = groups.withColumn("down", down).join(tops, "top").select("k", F.coalesce("down", "below").alias("to"))
    ends = rows.where("next_text is null").withColumn("k", F.struct("last", "g")).join(groups.join(heads, "to"), "k")
    ends = ends.select("doc_id", "text", "signature", F.col("head_text").alias("next_text"), F.col("head_signature").alias("next_signature"))
    return rows.where("next_text is not null").select(*ends.columns).unionByName(ends)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each whole text and of its edited text, and their likenesses: a row for each row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document in
    descending doc_id. Null texts count as empty. A text of white space has an empty fingerprint. An empty table gives no rows;
    other columns are ignored. near_next compares with the next document's fingerprint.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_signature(base, "text", "signature")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.when(half > 0, F.substring(F.col("next_text"), F.lit(1), half)).otherwise(""))
    rows = rows.select("doc_id", "n_chars", "signature", "next_signature", edited.alias("edited"))
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
