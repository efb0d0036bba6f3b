"""Near-duplicates: rare shingles propose pairs, SimHashes prune them, whole sets decide.

Two texts link if their sets of five-word shingles have a similarity of 0.8 or more. In one
order of all shingles, the first that such a pair shares lies among the first
``n - ceil(0.8 n) + 1`` of either text (prefix filter). The order puts rare shingles first,
by counts of hashed shingles in a sample; a poor count makes more candidates, never fewer
links. A pair's 256-bit SimHashes must differ in at most ``RADIUS`` bits: sets of that
similarity have a cosine of 0.889 or more, so they differ in 38.8 bits on average (standard
deviation 5.7) and the radius is seven deviations away; sets under ``FEW`` shingles skip this
test. Pairs that are left, few of all, are verified on whole sets.

Close copies are linked first: BK-trees over the first 64 bits of the SimHashes (operator 10)
give a spanning forest of those within three bits. Texts that share a prefix shingle are then
compared with one of them, first with the one that has the fewest rarer shingles, as edits of
a common text add rare ones, later with one drawn anew in every turn, until that stops to find
much; so a large group of near copies costs a few comparisons per member. Those still in
different components then meet in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.llm.common import partitions, rows_of
from boxlens.llm.components import components
from boxlens.llm.simhash import fingerprint_links
from boxlens.session import materialize, release

SHINGLE = 5
NUM, DEN = 4, 5  # least similarity of a link
COUNTERS = 1 << 20  # hashed counts that order the shingles, a byte each
SAMPLE = 8  # one in so many distinct texts is counted
SLICE = 1 << 17  # shingles hashed at a time within one text
TURNS = 4  # comparisons with one member at most, before tiles
TILE = 1024  # members of a group that meet another such part in one task
HOT = 64  # level of a counter (256 in the sample) from which a shingle is taken as shared without a look
WORDS, RADIUS, FEW = 4, 80, 32  # 64-bit words of a SimHash, bits that may differ, and sets that are too small for it
BUCKET_ROWS = 1 << 18  # prefix rows that are gathered together
MAP_BITS = 26  # of the map that lets needed texts through
PACKED = np.dtype([("hash", "<u8"), ("digest", "<i8"), ("size", "<u2"), ("pos", "<u2")])
SLIM = np.dtype([("hash", "<u4"), ("digest", "<i8"), ("size", "<u2"), ("pos", "<u2")])
HELD = 1 << 20  # prefix rows packed together
ROWS = 1 << 16  # rows of a written batch
SIGNED = ("digest", "n", *[f"f{w}" for w in range(WORDS)])
SIZE_STEP = np.log(1.001)  # of the size classes: coarse ones let through many pairs just below the least similarity
PLACES = 32767  # of a shingle within its set


def shingles(data: bytes) -> np.ndarray:
    """Ascending distinct hashes of the word shingles of UTF-8 text; a shorter text is one shingle, an empty one has none."""
    words = data.lower().split()  # on bytes: A-Z only, and white space \x20 \x09-\x0D only
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    parts = []
    for lo in range(0, len(words) - SHINGLE + 1, SLICE):
        part = words[lo : lo + SLICE + SHINGLE - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64))
    return np.unique(np.concatenate(parts))


def _prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _digest(every: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(every.tobytes())).astype(np.int64))


def simhash(every: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set in ``WORDS`` unsigned 64-bit words."""
    ones = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(every), SLICE):
        part = every[lo : lo + SLICE, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the mixer of SplitMix64
            part = (part ^ (part >> np.uint64(shift))) * np.uint64(factor)
        part ^= part >> np.uint64(31)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(every), bitorder="little").view(np.uint64)


def _signatures(text_col: str):
    """Rows with digest and size of their shingle set, and its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("doc").field(text_col).cast(pa.binary()):
                every = shingles(text.as_py() or b"")
                found.append((_digest(every), len(every), *simhash(every).view(np.int64).tolist()))
            columns = np.array(found, np.int64).reshape(-1, 2 + WORDS).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=[*batch.schema.names, *SIGNED])

    return run


def _in_map(wanted):
    """(digest, text) rows that the map lets through: all that are wanted, and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint64)
        for batch in batches:
            at = batch.column("digest").to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            keep = bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
            yield batch.filter(pa.array(keep))

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for text in rows_of(batch):
            np.add.at(counts, (shingles(text) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    for lo in range(0, len(at), ROWS):
        part = at[lo : lo + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["counter", "n"])


def _size_class(n: int) -> int:
    """Sizes whose ratio is 0.8 or more lie at most ``CLASSES`` classes apart."""
    return int(np.log(n) / SIZE_STEP)


CLASSES = int(np.log(DEN / NUM) / SIZE_STEP) + 1


def _prefixes(level, bucket_bits: int):
    """(bucket, packed rows): the prefix shingles of every text, dealt by their hash, frequent ones anywhere (negative buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(level.value, np.uint8)
        task = TaskContext.get().partitionId()

        def out(parts, buckets):
            rows, bucket = np.concatenate(parts), np.concatenate(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
                # the bucket says the first bits of a hash; 32 more tell its shingles apart well enough, as pairs are verified
                part = rows[a:b]
                if bucket[a] >= 0:
                    part = np.empty(b - a, SLIM)
                    part["hash"] = rows["hash"][a:b] >> np.uint64(32 - bucket_bits) & np.uint64(0xFFFFFFFF)
                    for c in ("digest", "size", "pos"):
                        part[c] = rows[c][a:b]
                blobs.append(part.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

        parts, buckets, seen, held = [], [], set(), 0
        for batch in batches:
            for text in rows_of(batch):
                every = shingles(text)
                if not len(every) or (d := _digest(every)) in seen:
                    continue
                seen.add(d)
                rows = np.empty(_prefix(len(every)), PACKED)
                rank = levels[(every % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((every, rank))[: len(rows)]
                rows["hash"], rows["digest"], rows["size"] = every[first], d, _size_class(len(every))
                rows["pos"] = np.arange(len(rows)) * PLACES // len(every)  # how far into the set, rounded down
                parts.append(rows)
                bucket = (rows["hash"] >> np.uint64(64 - bucket_bits)).astype(np.int64)
                buckets.append(np.where(rank[first] >= HOT, -1 - task, bucket))
                held += len(rows)
                if held > HELD:
                    yield out(parts, buckets)
                    parts, buckets, seen, held = [], [], set(), 0
        if parts:
            yield out(parts, buckets)

    return run


def _shared(bucket_bits: int):
    """Rows (hash, digest, size, pos) of the shingles in more than one set's prefix; blobs come sorted by bucket.

    Rows of frequent shingles pass without being gathered, so what a bucket holds is bounded.
    """

    def columns(hashes: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), ROWS):
            part = [hashes[lo : lo + ROWS], *[rows[c][lo : lo + ROWS] for c in ("digest", "size", "pos")]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c).astype(k)) for c, k in zip(part, ("i8", "i8", "i2", "i2"), strict=True)], names=["hash", "digest", "size", "pos"])

    def gathered(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(blobs), SLIM)
        rows = rows[np.lexsort((rows["digest"], rows["hash"]))]
        new = np.r_[True, (rows["hash"][1:] != rows["hash"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1])]
        rows = rows[new]  # a text that comes again in another task
        same = rows["hash"][1:] == rows["hash"][:-1]
        rows = rows[np.r_[False, same] | np.r_[same, False]]
        yield from columns((np.uint64(bucket) << np.uint64(32) | rows["hash"]).view(np.int64), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, at = [], -1
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
                if bucket < 0:
                    rows = np.frombuffer(blob.as_py(), PACKED)
                    yield from columns((rows["hash"] >> np.uint64(32 - bucket_bits)).view(np.int64), rows)
                    continue
                if bucket != at and blobs:
                    yield from gathered(at, blobs)
                    blobs = []
                at = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from gathered(at, blobs)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).tobytes() for t in rows_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.binary())], names=["digest", "hashes"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sets have the least similarity or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _order(rows: DataFrame):
    """Broadcast of one byte per counter: the more often its shingles occur, the greater."""
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(_counts, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("int")
    found = counts.select("counter", level.alias("level")).filter("level > 0").toArrow()  # COUNTERS rows at most
    levels = np.zeros(COUNTERS, np.uint8)
    levels[found["counter"].to_numpy()] = found["level"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(levels.tobytes())


def _possible(size: Column, pos: Column, other_size: Column, other_pos: Column) -> Column:
    """Whether sets of these size classes, whose first common shingle lies that far into each, can be similar enough."""
    # of a set of n at most n (1 - pos / PLACES) shingles can be common, and 0.8 (n + m) / 1.8 must be; sizes are known by class
    most = lambda own, p, other: (NUM + DEN) * (1 - p / float(PLACES)) >= NUM * (1 + F.exp((other - own - 1) * float(SIZE_STEP)))
    return (F.abs(size - other_size) <= CLASSES) & most(size, pos, other_size) & most(other_size, other_pos, size)


def _wanted(pairs: DataFrame):
    """Broadcast of a map of 2 ** ``MAP_BITS`` bits, set for the digests of all pairs."""
    digests = pairs.select(F.explode(F.array("a", "b")).alias("digest"))
    words = digests.select(F.shiftrightunsigned("digest", 64 - MAP_BITS).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # a row per word of the map at most
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(bits.tobytes())


def _near_enough(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) whose SimHashes differ in at most ``RADIUS`` bits, or one of whose sets is too small for them."""
    side = lambda c: marks.select(F.col("digest").alias(c), F.col("n").alias(c + "n"), *[F.col(f"f{w}").alias(f"{c}{w}") for w in range(WORDS)])
    far = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(1, WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = NUM * F.greatest("an", "bn") <= DEN * F.least("an", "bn")
    return joined.filter(sizes & ((F.least("an", "bn") < FEW) | (far <= RADIUS))).select("a", "b")


def _verified(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Pairs whose whole sets are similar enough. Only texts of these pairs are moved, one per digest."""
    some = source.mapInArrow(_in_map(_wanted(pairs)), source.schema)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    found = some.join(needed, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    sets = materialize(found.mapInArrow(_sets, "digest bigint, hashes binary"), "similar-sets")
    a = sets.select(F.col("digest").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("digest").alias("b"), F.col("hashes").alias("y"))
    links = materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint"), "similar-links")
    release(sets)
    return links


def _tree_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) that BK-trees of 64-bit SimHashes propose: a forest over near ones, and a star over equal ones."""
    full = marks.filter("n > 0").select("digest", F.col("f0").alias("fp"))
    firsts = materialize(full.groupBy("fp").agg(F.min("digest").alias("first")), "similar-fingerprints")
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}first"))
    near = fingerprint_links(firsts.select("fp")).distinct().join(side("a"), "a").join(side("b"), "b").select(
        F.least("afirst", "bfirst").alias("a"), F.greatest("afirst", "bfirst").alias("b"))
    equal = full.join(firsts, "fp").filter("digest <> first").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    return near.union(equal).distinct()


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of groups that still lie in several components; ``part`` names each row's."""
    named = rows.drop("part").join(roots, rows["digest"] == roots["node"], "left")
    named = materialize(named.select("hash", "digest", "size", "pos", F.coalesce("root", "digest").alias("part")), "similar-named")
    open_ = named.groupBy("hash").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("hash")
    left = materialize(named.join(open_, "hash", "left_semi"), "similar-left")
    release(named, rows)
    return left


def _star_pairs(left: DataFrame, turn: int) -> DataFrame:
    """Every row with one member of its group: first that with the least edits, as far as rare shingles tell, then one drawn by the turn."""
    drawn = F.xxhash64("digest", F.lit(turn))
    center = F.min_by(F.struct("digest", "size", "pos", "part"), drawn if turn else F.struct("pos", drawn)).alias("other")
    return left.join(left.groupBy("hash").agg(center), "hash")


def _tile_pairs(left: DataFrame) -> DataFrame:
    """All rows of a group with each other, in tiles of at most about ``TILE`` rows a side."""
    parts = left.groupBy("hash").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    rows = left.join(parts, "hash").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    mine = rows.select("hash", "digest", "size", "pos", "part", "own", every.alias("their"))
    other = F.struct("digest", "size", "pos", "part").alias("other")
    theirs = rows.select("hash", other, F.col("own").alias("their"), every.alias("own"))
    return mine.join(theirs, ["hash", "own", "their"]).filter(F.col("digest") < F.col("other.digest"))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written rows: ``doc`` (all columns), ``key`` (named rows first, then by id, then any order) and the signature of the text."""
    key = F.struct(docs[id_col].isNull().alias("unnamed"), docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in SIGNED]])
    return materialize(rows.mapInArrow(_signatures(text_col), schema), "similar-rows")


def groups_of(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per distinct set of shingles of ``signed`` rows: digest, least (key that has it), component (least key reachable through links)."""
    spark = rows.sparkSession
    source = rows.select("digest", F.coalesce(F.col("doc")[text_col].cast("string"), F.lit("")).alias("text"))
    firsts = [F.first(c).alias(c) for c in SIGNED[1:]]
    marks = materialize(rows.groupBy("digest").agg(F.min("key").alias("least"), *firsts), "similar-marks")
    total = marks.agg(F.sum("n")).first()[0] or 0
    # as many buckets as keep a fifth of all shingles in parts of BUCKET_ROWS
    bits = min(31, max(8, (total // 5 // BUCKET_ROWS).bit_length()))
    packed = source.select("text").mapInArrow(_prefixes(_order(source), bits), "bucket bigint, rows binary")
    dealt = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    near = materialize(dealt.mapInArrow(_shared(bits), "hash bigint, digest bigint, size smallint, pos smallint"), "similar-near")
    done = materialize(_near_enough(_tree_pairs(marks), marks), "similar-pairs")
    links = _verified(done, source)
    roots = components(links, "similar-roots")
    left, turn, before, tiles = _open(near, roots), 0, 0, False
    while True:
        proposed = (_tile_pairs(left) if tiles else _star_pairs(left, turn)).filter(
            (F.col("part") != F.col("other.part")) & _possible(F.col("size"), F.col("pos"), F.col("other.size"), F.col("other.pos")))
        pairs = proposed.select(F.least("digest", "other.digest").alias("a"), F.greatest("digest", "other.digest").alias("b")).distinct()
        pairs = _near_enough(pairs, marks)
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "similar-pairs")
        done = done.union(pairs)
        new = _verified(pairs, source)
        links = links.union(new)
        release(roots)
        roots = components(links, "similar-roots")
        if tiles:
            break
        left = _open(left, roots)
        found, turn = new.count(), turn + 1
        tiles, before = turn == TURNS or 4 * found <= before or not found, found
    release(left)
    nodes = marks.join(roots, marks["digest"] == roots["node"], "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    nodes = materialize(nodes, "similar-nodes")
    names = nodes.groupBy("root").agg(F.min("least").alias("component"))
    return nodes.join(names, "root").select("digest", "least", "component")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct set of shingles: digest, least (id that has it), component (least id reachable through links).

    Nulls: a null text counts as empty; a null id is never a component's name unless the
    component has no other. Texts without words, and empty ones, are one group. Repeated
    rows and texts that differ in order of shingles, case of A-Z or white space only have one
    digest (64 bits). Very long texts are read whole, their shingles hashed in slices. An
    empty table gives an empty result; other columns are not read.
    """
    found = groups_of(signed(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text"))
    return found.select("digest", F.col("least.id").alias("least"), F.col("component.id").alias("component"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each is the least of its group: named rows first, then by id.

    Nulls, empty and long texts, repeats and empty tables as in ``similar_groups``.
    """
    rows = signed(docs, id_col, text_col)
    groups = groups_of(rows, text_col)
    copies = rows.select("digest", "key").join(groups.select("digest", "component"), "digest").filter(F.col("key.row") != F.col("component.row"))
    gone = materialize(copies.select(F.col("key.row").alias("row")), "similar-gone")
    return rows.join(gone, rows["key.row"] == gone["row"], "left_anti").select("doc.*")
