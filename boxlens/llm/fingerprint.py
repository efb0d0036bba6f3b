"""Document fingerprints by consistent weighted sampling (operator 8), in DataFrame functions only.

Terms are the lower-cased words of a text, weighted by their counts. For each of the
``SAMPLES`` samples every weighted term gets a level from two gamma variates and a uniform
one that are functions of (term, sample) alone, and the term with the least level is the
sample. Two texts agree on a sample with a chance of their generalised Jaccard similarity,
so the share of equal samples estimates it. As a level is practically unique to (term,
rounded weight), the least level itself stands for the sample, and a plain grouped minimum
finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.blocks import range_blocks
from boxlens.session import materialize

SAMPLES = 32
BLANK = r"\s+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def weighted_terms(text: Column) -> Column:
    """Array of (term hash, count) of a text: hashes sorted, each run of equal ones counted by its ends."""
    words = F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def runs(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return _let(starts, lambda s: F.transform(s, lambda at, i: F.struct(
            F.get(h, at).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(h)) - at).cast("double").alias("weight"))))

    none = F.array().cast("array<struct<term:bigint,weight:double>>")
    return _let(hashes, lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(none))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """Number in (0, 1) from ``width`` bits."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) if shift + width < 64 else F.shiftrightunsigned(bits, shift)
    return (part.cast("double") + 0.5) * F.lit(2.0**-width)


def level(term: Column, log_weight: Column, sample: int) -> Column:
    """Level of a term in a sample: ln c - r (t - b + 1) with r, c ~ Gamma(2, 1), b uniform, t = floor(ln w / r + b)."""
    one = F.xxhash64(term, F.lit(sample))
    two = F.xxhash64(term, F.lit(sample), F.lit(1))
    r = -F.ln(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    b = _uniform(one, 42, 22)
    log_c = F.ln(-F.ln(_uniform(two, 0, 32) * _uniform(two, 32, 32)))
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def signatures(texts: DataFrame, keys: tuple[str, ...] = ("key",), text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, signature) of every text; rows of equal keys must have equal texts and become one.

    ``signature`` holds a 32-bit number per sample, zeros for a text without words. Terms
    never leave the task of their text: they fold into one row per text before the exchange.
    """
    terms = texts.select(*keys, F.explode_outer(weighted_terms(F.col(text))).alias("t")).select(*keys, "t.term", F.ln("t.weight").alias("log_weight"))
    least = terms.groupBy(*keys).agg(*[F.min(level(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)])
    number = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return least.select(*keys, F.array(*[number(f"s{k}") for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples, an estimate of generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _in_order(rows: DataFrame) -> DataFrame:
    """(key, id, n, copies, next and previous key, n of the previous) of distinct texts in ascending id, in a ring.

    A row number would need one task; instead the neighbour across a block's edge comes
    from a table of one row per block.
    """
    distinct = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("h").alias("h"), F.count("*").alias("copies"))
    order = [(c, True) for c in ("last", "id", "h")]
    blocks = range_blocks(distinct.withColumn("last", F.col("id").isNull()), order, "text-order")
    place = F.struct("last", "id", "h")
    item = F.struct("key", "n")
    ends = blocks.groupBy("block").agg(F.min_by(item, place).alias("first"), F.max_by(item, place).alias("final"))
    ring = Window.orderBy("block")  # as many rows as blocks
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select(
        "block", F.coalesce(F.lag("final").over(ring), F.last("final").over(whole)).alias("before"),
        F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("after"))
    inside = Window.partitionBy("block").orderBy("last", "id", "h")
    near = blocks.join(F.broadcast(edges), "block").select(
        "key", "id", "n", "copies", F.coalesce(F.lag(item).over(inside), F.col("before")).alias("before"),
        F.coalesce(F.lead(item).over(inside), F.col("after")).alias("after"))
    return near.select(
        "key", "id", "n", "copies", F.col("after.key").alias("next_key"), F.col("before.key").alias("previous_key"), F.col("before.n").alias("previous_n"))


def edited_texts(texts: DataFrame, order: DataFrame) -> DataFrame:
    """(key, edited): the last quarter of each text gives way to the beginning of the next one.

    Whole texts are exchanged once: the heads and the borrowed beginnings read the same join.
    """
    placed = texts.join(order, "key")
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = placed.select("key", F.substring(F.col("text"), F.lit(1), F.col("n").cast("int") - quarter(F.col("n"))).alias("head"))
    tails = placed.select(F.col("previous_key").alias("key"), F.substring(F.col("text"), F.lit(1), quarter(F.col("previous_n"))).alias("tail"))
    tails = tails.groupBy("key").agg(F.first("tail").alias("tail"))  # a repeated row lends its beginning once
    return heads.join(tails, "key").select("key", F.concat("head", "tail").alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per document row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document (ascending id, then digest
    of the text; null ids last; after the last, the first). Null texts are empty. A text
    without words has a fingerprint of zeros, and two such are alike. Repeated rows count as one
    document in the order and come back once per occurrence. An empty table gives an empty
    result; other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    rows = rows.withColumn("key", F.concat_ws(":", F.hex("h"), name))
    order = materialize(_in_order(rows.select("key", "id", "h", F.length("text").cast("bigint").alias("n"))), "text-ring")
    texts = rows.select("key", "text")
    own = materialize(signatures(texts, samples=samples), "signatures")
    edited = edited_texts(texts, order).withColumn("edited_sha256", F.sha2("edited", 256))
    changed = signatures(edited, ("key", "edited_sha256"), "edited", samples).withColumnRenamed("signature", "changed")
    following = own.select(F.col("key").alias("next_key"), F.col("signature").alias("next"))
    joined = order.join(own, "key").join(changed, "key").join(following, "next_key")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "id", F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("changed")).alias("near_edited"), likeness(F.col("signature"), F.col("next")).alias("near_next"))
