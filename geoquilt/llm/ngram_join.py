"""Jaccard self-join of documents on their word n-grams by vertical partitioning.

The order of all n-grams: first those of no heavy bucket of a corpus-wide count sketch, then the heavier the later;
within that by hash. The order is cut into fragments, so a document falls into segments. Any total order gives right
results; this one puts what many documents share last. Two documents that reach the threshold share an n-gram among the
first (1 - t) of either, so the first fragments propose pairs. A pair's overlap is counted in each fragment apart, from
its two segments there, and summed per pair; pairs that the first fragments rule out never reach the others.

Large groups of near copies would still propose all their pairs. So a document that resembles the best-shared document of
its lists takes it for its root and is held as what it lacks of it and has besides (again by fragment). With m for what a
document lacks, d for what it has besides, of two documents of one root

    overlap = |root| - |m_a| - |m_b| + |m_a & m_b| + |d_a & d_b|,

so either they link by those sizes alone, which the document of the smallest size decides for all, or they must share
some of their few differences, and those are joined, each group under its own counts. Documents of different roots meet
through their roots: overlap <= |root_a & root_b| + |d_a| + |d_b|. Every bound is exact, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import sketch, textscan
from .shared import Tables, arrow_rows, components, few_files, lean, runs, text_buffers, written

_BUCKETS = 20
_LEADS = 4
_LIGHT = 3  # fragments of n-grams of no heavy bucket, by hash; two more hold the heavy ones
_FRAGMENTS = _LIGHT + 2
_EARLY = 2  # of them tell first whether a pair can still link
_SAMPLE = 32  # n-grams of each tell whether two documents look alike


def document_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-gram hashes, ascending: A-Z lower-cased, fewer than n words as one sequence, none for no word."""
    for i, j in runs(offsets, 1 << 19):
        part = offsets[i : j + 1] - offsets[i]
        piece = textscan.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = textscan.words(piece, part)
        h = textscan.span_hashes(piece, starts, ends)
        grams = textscan.windows(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield np.array([textscan.whole(h[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(np.sum(textscan.mix(s, 1), dtype=np.uint64)), int(np.sum(textscan.mix(s, 2), dtype=np.uint64))


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (doc_id, size, d1, d2), the digest of each document's set. kind 1: (bucket, count), a partition's heavy buckets."""
    names = ["kind", "doc_id", "size", "d1", "d2"]

    def run(batches):
        counts = np.zeros(1 << _BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in runs(offsets, 1 << 20):
                part = offsets[i : j + 1]
                sets = list(document_sets(data[part[0] : part[-1]], part - part[0], n))
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - _BUCKETS)).astype(np.int64), minlength=1 << _BUCKETS)
                digests = [_digest(s) for s in sets]
                numbers = [np.array(list(map(len, sets)), np.int64), *(_signed([d[k] for d in digests]) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i), *map(pa.array, numbers)], names)
        heavy = np.flatnonzero(counts > 2 * counts.mean() + 8)
        none = np.zeros(len(heavy), np.int64)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (none.astype(np.int32) + 1, heavy, counts[heavy], none, none))], names)

    return docs.mapInArrow(lean(run), "kind int, doc_id long, size long, d1 long, d2 long")


def _levels(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Heavy buckets and how heavy: log2 of count over mean. At most 2**20 / 2 of them, by their definition."""
    total = profile.where("kind = 0").agg(F.sum("size")).first()[0] or 0
    mean = max(1.0, total / (1 << _BUCKETS))
    heavy = profile.where("kind = 1").groupBy("doc_id").agg(F.sum("size").alias("size")).where(F.col("size") > 2 * mean + 8)
    found = heavy.toPandas().sort_values("doc_id")
    return found["doc_id"].to_numpy(np.int64), np.maximum(1, np.log2(found["size"].to_numpy(float) / mean)).astype(np.int64)


def _in_order(s: np.ndarray, buckets: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, and where its segments begin and end (one place more than there are fragments)."""
    mine = np.zeros(len(s), np.int64)
    if len(buckets):
        bucket = (s >> np.uint64(64 - _BUCKETS)).astype(np.int64)
        at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
        mine = np.where(buckets[at] == bucket, level[at], 0)
    order = np.argsort(mine, kind="stable")
    s, mine = s[order], mine[order]
    light = ((s >> np.uint64(32)) * np.uint64(_LIGHT) >> np.uint64(32)).astype(np.int64)
    fragment = np.where(mine == 0, light, np.where(mine < 3, _LIGHT, _LIGHT + 1))
    return s, np.searchsorted(fragment, np.arange(_FRAGMENTS + 1))


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return textscan.mix(np.asarray(ids, np.int64).view(np.uint64), 77)


def joined(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10), sketch_bits: int = 27) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs.

    Documents link when their n-gram sets' Jaccard similarity reaches the threshold, in exact integer arithmetic;
    component_id is the smallest doc_id reachable by links. Documents of equal sets are one class from the start, and a
    pair is only ever formed between classes, so a group of copies costs what one document does; pairs of documents that
    are already connected are not formed. Empty and null texts: 0 shingles, linked with nothing. Null ids: returned with a
    null component, linked with nothing. Repeated rows are returned each. Rows that share a doc_id but not the text are
    documents of their own, each with the label of its own text. Other columns are not read. n-grams are told apart by
    64-bit hashes, sets by 128 bits: of N documents' n-grams of a link's size two meet by chance with odds below N / 2**60.
    """
    sets, named, _ = _labelled(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), n, threshold, sketch_bits)
    some = sets.where("size > 0 and doc_id is not null")
    out = some.join(named.drop("rep", "component"), ["d1", "d2", "size"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = sets.where("size = 0 or doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(alone)


def _labelled(docs: DataFrame, n: int, threshold: Fraction, sketch_bits: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (doc_id, size, d1, d2) for each row of docs; classes of equal sets (d1, d2, size, rep, component, component_id);
    and whether a doc_id repeats. Classes are then nodes by a number of their own, else by their smallest doc_id (rep)."""
    with arrow_rows(docs.sparkSession, 1000):
        profile = written(_profile(docs, n), "profile")
        sets = profile.where("kind = 0").select("doc_id", "size", "d1", "d2")
        some = sets.where("size > 0 and doc_id is not null")
        classes = some.groupBy("d1", "d2", "size").agg(F.min("doc_id").alias("rep"))
        repeats = sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
        classes = written(classes.withColumn("node", F.monotonically_increasing_id() if repeats else F.col("rep")), "classes")
        base = docs.where("doc_id is not null").withColumnRenamed("doc_id", "doc")
        others = some.join(classes, ["d1", "d2", "size"]).where("doc_id <> rep").select(F.col("doc_id").alias("doc"))  # copies, which their class stands for
        if repeats:  # an id may have several texts: of each class one text stands for it, under the class's number
            mine = _with_digest(docs, n).withColumnsRenamed({"_size": "size", "_d1": "d1", "_d2": "d2"}).join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "size", "d1", "d2"])
            base = written(mine.dropDuplicates(["node"]).select(F.col("node").alias("doc"), "text"), "representatives")
            others = None
        links = _links(base, others, n, _levels(profile), threshold, sketch_bits)
    labels = components(links)
    named = classes.join(labels.withColumnRenamed("component", "found"), "node", "left").withColumn("component", F.coalesce("found", "node")).drop("node", "found")
    if not repeats:
        return sets, named.withColumn("component_id", F.col("component")), False
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return sets, named.join(lowest, "component").select("d1", "d2", "size", "rep", "component", "component_id"), True


class _Rule:
    """The threshold num / den in integers: two sets link if their overlap times `unit` reaches num times the sum of their sizes."""

    def __init__(self, threshold: Fraction):
        self.num, self.den = threshold.numerator, threshold.denominator
        self.unit = self.num + self.den

    def needed(self, na: Column, nb: Column) -> Column:
        return self.ceil((na + nb) * self.num)

    def ceil(self, units: Column) -> Column:
        return F.ceil(units / F.lit(self.unit)).cast("long")

    def near(self, low: Column, high: Column) -> Column:
        """Sizes of which the smaller can reach the threshold with the larger."""
        return low * self.den >= high * self.num

    def alike(self, na: Column, nb: Column) -> Column:
        """The overlap from which a document takes another one for its root: a quarter of the larger size, which keeps its differences within a few times its n-grams."""
        return F.floor((F.greatest(na, nb) + 3) / 4).cast("long")


def _postings(base: DataFrame, others: DataFrame | None, n: int, levels: tuple, rule: _Rule, sketch_bits: int, tables: Tables) -> DataFrame:
    """(token, doc, size, nth, place, shared): of each document's first n-grams those that others have too among theirs.

    place: in the document's order; nth: among the document's rows here; shared: their share of the first n-grams, by 1000.
    """
    spark = base.sparkSession
    heavy = spark.sparkContext.broadcast(levels)
    num, den = rule.num, rule.den

    def prefixes(batches):
        for batch in batches:
            found, size, tokens = [], [], []
            for k, s in enumerate(document_sets(*text_buffers(batch.column(1)), n)):
                if len(s):
                    found.append(k)
                    size.append(len(s))
                    tokens.append(_signed(_in_order(s, *heavy.value)[0][: len(s) - -(-len(s) * num // den) + 1]))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, tokens)]).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), pa.array(size, pa.int64()), lists], ["doc", "size", "tokens"])

    heads = base.mapInArrow(lean(prefixes), "doc long, size long, tokens array<long>")
    heads = tables.written(heads if others is None else heads.join(others, "doc", "left_anti"), "prefixes")

    def hashes(batch: pa.RecordBatch):
        yield np.asarray(batch.column(0).flatten(), np.int64).view(np.uint64)

    repeated = spark.sparkContext.broadcast(sketch.merged(heads.select("tokens"), hashes, sketch_bits, 2))

    def postings(batches):
        held = repeated.value
        for batch in batches:
            tokens = batch.column(2)
            flat = np.asarray(tokens.flatten(), np.int64)
            many = np.diff(np.asarray(tokens.offsets))
            doc = np.repeat(np.arange(batch.num_rows), many)
            maybe = held.maybe(flat.view(np.uint64))
            mine = doc[maybe]
            count = np.bincount(mine, minlength=batch.num_rows)
            nth = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many))[maybe]
            shared = count * 1000 // np.maximum(1, many)
            at = pa.array(mine)
            numbers = [pa.array(x.astype(np.int32)) for x in (nth, place, shared[mine])]
            yield pa.RecordBatch.from_arrays([pa.array(flat[maybe]), batch.column(0).take(at), batch.column(1).take(at), *numbers], ["token", "doc", "size", "nth", "place", "shared"])

    posts = tables.written(heads.mapInArrow(lean(postings), "token long, doc long, size long, nth int, place int, shared int"), "postings")
    repeated.unpersist()
    return posts


def _segments(base: DataFrame, ids: DataFrame, n: int, levels: tuple, tables: Tables, sample: int = 0) -> DataFrame:
    """(doc, fragment, tokens) of the documents of ids (doc), or as one fragment those `sample` n-grams of each that come first by another hash, by a bitmap (64 MB a row at most) that others pass by chance, which then find no pair."""
    spark = base.sparkSession
    heavy = spark.sparkContext.broadcast(levels)

    def id_hashes(batch: pa.RecordBatch):
        yield _id_hash(np.asarray(batch.column(0), np.int64))

    ids = ids.distinct()
    bits = min(29, max(16, (16 * ids.count()).bit_length()))
    wanted = spark.sparkContext.broadcast(sketch.merged(ids, id_hashes, bits, 2, least=1))

    def cut(batches):
        for batch in batches:
            found = np.flatnonzero(wanted.value.maybe(_id_hash(np.asarray(batch.column(0), np.int64))))
            data, offsets = text_buffers(batch.column(1).take(pa.array(found)))
            for low, high in runs(offsets, 1 << 22):
                doc, parts, bounds = [], [], [0]
                for k, s in enumerate(document_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n), low):
                    doc.append(found[k])
                    s, cuts = _in_order(s, *heavy.value)
                    if sample:
                        s = s[np.argsort(textscan.mix(s, 7))[:sample]]
                        cuts = np.array([0, len(s)])
                    parts.append(_signed(s))
                    bounds.extend((cuts[1:] + bounds[-1]).tolist())
                flat = np.concatenate(parts)
                many = 1 if sample else _FRAGMENTS
                doc = np.repeat(np.asarray(batch.column(0), np.int64)[doc], many)
                lists = pa.ListArray.from_arrays(np.array(bounds, np.int32), flat)
                fragment = np.tile(np.arange(many, dtype=np.int32), high - low)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(fragment), lists], ["doc", "fragment", "tokens"]).filter(pa.array(np.diff(bounds) > 0))

    out = tables.kept(few_files(base, 8).mapInArrow(lean(cut), "doc long, fragment int, tokens array<long>"))
    wanted.unpersist()
    return out


def _by_fragment(pairs: DataFrame, segments: DataFrame, fragments: range) -> DataFrame:
    """A row of each pair (a, b, ...) for each fragment, with the two segments x and y (null: empty)."""
    rows = pairs.withColumn("fragment", F.explode(F.array(*map(F.lit, fragments))))
    some = segments.where(F.col("fragment").between(fragments[0], fragments[-1]))
    side = lambda doc, tokens: some.select(F.col("doc").alias(doc), "fragment", F.col("tokens").alias(tokens))
    return rows.join(side("a", "x"), ["a", "fragment"], "left").join(side("b", "y"), ["b", "fragment"], "left")


def _common() -> Column:
    return F.coalesce(F.array_size(F.array_intersect("x", "y")), F.lit(0))


def _length(tokens: str) -> Column:
    return F.coalesce(F.array_size(tokens), F.lit(0)).cast("long")


def _overlaps(pairs: DataFrame, segments: DataFrame, tables: Tables) -> DataFrame:
    """pairs (a, b, na, nb, need, ...) whose overlap reaches need, with it: partial counts of each fragment, summed per pair.

    The early fragments come first; a pair goes on while what they count and what is left of both sets reach need.
    """
    keys = pairs.columns
    partial = _by_fragment(pairs, segments, range(_EARLY)).select(*keys, _common().alias("c"), _length("x").alias("cx"), _length("y").alias("cy"))
    summed = partial.groupBy(*keys).agg(F.sum("c").alias("so_far"), F.sum("cx").alias("cx"), F.sum("cy").alias("cy"))
    held = tables.kept(summed.where(F.col("so_far") + F.least(F.col("na") - F.col("cx"), F.col("nb") - F.col("cy")) >= F.col("need")).drop("cx", "cy"))
    partial = _by_fragment(held, segments, range(_EARLY, _FRAGMENTS)).select(*keys, "so_far", _common().alias("c"))
    summed = partial.groupBy(*keys, "so_far").agg(F.sum("c").alias("c")).withColumn("overlap", F.col("so_far") + F.col("c"))
    return tables.kept(summed.where("overlap >= need").select(*keys, "overlap"))


def _compared(base: DataFrame, pairs: DataFrame, n: int, levels: tuple, tables: Tables) -> DataFrame:
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))
    return _overlaps(pairs, _segments(base, ids, n, levels, tables), tables)


def _links(base: DataFrame, others: DataFrame | None, n: int, levels: tuple, threshold: Fraction, sketch_bits: int) -> DataFrame:
    """Links (a, b) between documents of base (doc, text), but those of others (doc), that connect what all links connect."""
    rule = _Rule(threshold)
    tables = Tables()
    posts = _postings(base, others, n, levels, rule, sketch_bits, tables)
    if posts.limit(1).count() == 0:  # no n-gram of one document's first ones is among another's
        tables.discard()
        return base.sparkSession.createDataFrame([], "a long, b long")
    homes, differences, sure = _rooted(base, posts, n, levels, rule, tables)
    labels = tables.kept(components(sure).withColumnRenamed("node", "doc"))
    homes = tables.kept(homes.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    inside = _of_one_root(homes, differences, rule, tables)
    across = _of_two_roots(base, posts, homes, n, levels, rule, tables)
    out = written(sure.union(inside).union(across), "links")
    tables.discard()
    return out


def _followed(base: DataFrame, posts: DataFrame, leaders: DataFrame, settled: DataFrame | None, n: int, levels: tuple, rule: _Rule, tables: Tables) -> DataFrame:
    """(a, b, na, nb): documents b of posts, but those settled (b), with the leader a that they follow.

    A list's best leader is that of most members, then the best shared, then the smallest. A document is compared with
    the best leader of most of its lists, by samples of their n-grams, and follows it if those look alike, so each costs one
    pair whatever its lists hold. Who follows whom decides what work there is, not what links.
    """
    best = leaders.groupBy("token").agg(F.max(F.struct("members", "shared", -F.col("doc"), "size")).alias("p"))
    best = best.select("token", (-F.col("p.col3")).alias("a"), F.col("p.size").alias("na"), F.struct("p.members", "p.shared").alias("standing"))
    star = posts.select("token", F.col("doc").alias("b"), F.col("size").alias("nb")).join(best, "token").where("a <> b")
    star = star.where(F.least("na", "nb") >= rule.alike(F.col("na"), F.col("nb")))
    star = star.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("votes"), F.max("standing").alias("standing"))
    star = star.groupBy("b", "nb").agg(F.max(F.struct("votes", "standing", -F.col("a"), "na")).alias("p")).select((-F.col("p.col3")).alias("a"), "b", "p.na", "nb")
    if settled is not None:
        star = star.join(settled, "b", "left_anti")
    star = tables.kept(star)
    segments = _segments(base, star.select(F.col("a").alias("doc")).union(star.select(F.col("b").alias("doc"))), n, levels, tables, _SAMPLE)
    parts = _by_fragment(star, segments, range(1)).select(*star.columns, _common().alias("c"), _length("x").alias("cx"), _length("y").alias("cy"))
    look = parts.groupBy(*star.columns).agg(F.sum("c").alias("c"), F.sum("cx").alias("cx"), F.sum("cy").alias("cy")).where(F.col("c") * 5 >= F.greatest("cx", "cy"))
    # a leader comes before all others of its lists in one order, so following it never turns in a circle
    return tables.kept(_climbed(look.select(*star.columns), tables))


def _climbed(up: DataFrame, tables: Tables) -> DataFrame:
    """up (a, b, na, nb) with the last a that is reached from each b."""
    while True:
        above = up.select(F.col("b").alias("a"), F.col("a").alias("a2"), F.col("na").alias("na2"))
        further = tables.kept(up.join(above, "a", "left"))
        up = further.select(F.coalesce("a2", "a").alias("a"), "b", F.coalesce("na2", "na").alias("na"), "nb")
        if further.where("a2 is not null").limit(1).count() == 0:
            return up


def _rooted(base: DataFrame, posts: DataFrame, n: int, levels: tuple, rule: _Rule, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with posts and their roots (doc, root, size, root_size, lacks, besides; most are their own root); by
    fragment what those of another root lack of it and have besides (doc, root, fragment, tokens); links among them."""
    # first the best-shared document of each list, as an original is whose near copies differ from it each in their own way
    up = _followed(base, posts.where(F.col("nth") < _LEADS), posts.withColumn("members", F.lit(1).cast("long")), None, n, levels, rule, tables)
    # then roots of few documents follow those of more
    members = up.groupBy(F.col("a").alias("doc")).agg((F.count("*") + 1).alias("members"))
    further = _followed(base, posts.where(F.col("nth") < 4 * _LEADS), posts.join(members, "doc"), up.select("b"), n, levels, rule, tables)
    up = tables.kept(_climbed(up.union(further), tables))
    segments = _segments(base, up.select(F.col("a").alias("doc")).union(up.select(F.col("b").alias("doc"))), n, levels, tables)
    parts = _by_fragment(up, segments, range(_FRAGMENTS))
    none = F.array().cast("array<long>")
    lists = [F.coalesce(F.col(c), none) for c in "xy"]
    parts = parts.withColumn("lacking", F.array_except(*lists)).withColumn("extra", F.array_except(*lists[::-1]))
    parts = tables.kept(parts.select("a", "b", "na", "nb", "fragment", F.array_size("lacking").alias("lacks"), F.array_size("extra").alias("besides"), F.concat("lacking", "extra").alias("tokens")))
    sums = parts.groupBy("a", "b", "na", "nb").agg(F.sum("lacks").alias("lacks"), F.sum("besides").alias("besides"))
    sums = sums.where(F.col("na") - F.col("lacks") >= rule.alike(F.col("na"), F.col("nb")))
    rooted = tables.kept(sums.select(F.col("b").alias("doc"), F.col("a").alias("root"), F.col("nb").alias("size"), F.col("na").alias("root_size"), "lacks", "besides"))
    differences = parts.join(rooted.select(F.col("doc").alias("b")), "b", "left_semi").select(F.col("b").alias("doc"), F.col("a").alias("root"), "fragment", "tokens")
    differences = tables.kept(differences.where(F.array_size("tokens") > 0))
    zero = F.lit(0).cast("long")
    own = posts.groupBy("doc").agg(F.max("size").alias("size")).join(rooted.select("doc"), "doc", "left_anti")
    homes = rooted.union(own.select("doc", F.col("doc").alias("root"), "size", F.col("size").alias("root_size"), zero, zero))
    homes = tables.kept(homes.withColumn("cost", F.col("size") * rule.num + F.col("lacks") * rule.unit).withColumn("gain", F.col("besides") * rule.unit - F.col("size") * rule.num))
    # of one root, two link by sizes alone if their costs' sum is within root_size * unit; the least costly one tells for all
    least = homes.groupBy("root").agg(F.min(F.struct("cost", "doc")).alias("p"), F.count("*").alias("n")).where("n > 1").select("root", F.col("p.cost").alias("low"), F.col("p.doc").alias("x"))
    by_size = homes.join(least, "root").where("doc <> x").where(F.col("cost") + F.col("low") <= F.col("root_size") * rule.unit).select(F.col("x").alias("a"), F.col("doc").alias("b"))
    to_root = rooted.where((F.col("root_size") - F.col("lacks")) * rule.unit >= (F.col("size") + F.col("root_size")) * rule.num).select(F.col("root").alias("a"), F.col("doc").alias("b"))
    sure = tables.kept(by_size.union(to_root))
    return homes, differences, sure


def _of_one_root(homes: DataFrame, differences: DataFrame, rule: _Rule, tables: Tables) -> DataFrame:
    """Links of documents of one root that are not connected yet: they share so many of their differences."""
    groups = homes.groupBy("root").agg(F.min("cost").alias("low"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("root", "low")
    tokens = differences.join(groups, "root").select("doc", "root", "low", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("root", "token").agg(F.count("*").alias("n")).where("n > 1")
    lists = tokens.join(counts, ["root", "token"]).groupBy("doc", "root", "low").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("s"))  # a document's own differences
    lists = lists.join(homes.select("doc", "cost", "root_size", "lacks", "besides", "component"), "doc").withColumn("many", F.array_size("s"))
    lists = lists.withColumn("least", F.greatest(F.lit(1), rule.ceil(F.col("cost") + F.col("low") - F.col("root_size") * rule.unit))).where("many >= least")
    rows = lists.select("doc", "root", "root_size", "cost", "many", F.col("least").cast("int").alias("least"), "component", (F.col("lacks") + F.col("besides")).alias("whole"), F.posexplode(F.slice("s.token", F.lit(1), F.col("many") - F.col("least").cast("int") + 1)).alias("at", "token"))
    rows = tables.kept(rows)
    side = lambda k: rows.select("root", "token", "root_size", *[F.col(c).alias(c + k) for c in ("doc", "cost", "many", "least", "component", "whole", "at")])
    need = rule.ceil(F.col("cost1") + F.col("cost2") - F.col("root_size") * rule.unit)
    both = side("1").join(side("2").drop("root_size"), ["root", "token"]).where("doc1 < doc2 and component1 <> component2").withColumn("need", need)
    both = both.where(F.least("at1", "at2") + F.least(F.col("many1") - F.col("at1"), F.col("many2") - F.col("at2")) >= F.col("need"))
    # as with whole sets: of what two must share, only so much can lie beyond the first ones of the one that ends first
    pairs = both.groupBy(F.col("doc1").alias("a"), F.col("doc2").alias("b"), F.col("whole1").alias("na"), F.col("whole2").alias("nb"), "need", F.greatest("least1", "least2").alias("beyond"))
    pairs = pairs.agg(F.count("*").alias("common")).where(F.col("common") > F.col("need") - F.col("beyond")).select("a", "b", "na", "nb", "need")
    return _overlaps(tables.kept(pairs), differences.select("doc", "fragment", "tokens"), tables).select("a", "b")


def _of_two_roots(base: DataFrame, posts: DataFrame, homes: DataFrame, n: int, levels: tuple, rule: _Rule, tables: Tables) -> DataFrame:
    """Links of documents of different roots that are not connected yet, of which one for each two components at least."""
    # all that follows, up to the pairs, goes by the one exchange by token
    named = posts.join(homes.select("doc", "root", "component"), "doc").select("token", "root", "size", "nth", (F.col("size") - F.col("place")).alias("onward"), "component").repartition("token")
    rooted = named.groupBy("token", "root").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("nth").alias("nth"), F.max("onward").alias("onward"), F.min("component").alias("c"), F.max("component").alias("d"))
    open_ = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("c").alias("c"), F.max("d").alias("d")).where("x <> y and c <> d").select("token")
    rooted = rooted.join(open_, "token", "left_semi")
    side = lambda k: rooted.select("token", *[F.col(c).alias(c + k) for c in ("root", "low", "high", "nth", "onward", "c", "d")])
    both = side("1").join(side("2"), "token").where("root1 < root2 and not (c1 = d1 and c2 = d2 and c1 = c2)")
    both = both.where(rule.near(F.col("high1"), F.col("low2")) & rule.near(F.col("high2"), F.col("low1")))
    # before a common n-gram only those with posts can be common, after it what is left
    reach = F.least("nth1", "nth2") + F.least("onward1", "onward2")
    pairs = both.where(reach >= rule.needed(F.col("low1"), F.col("low2"))).groupBy(F.col("root1").alias("a"), F.col("root2").alias("b")).agg(F.count("*").alias("common"))
    groups = homes.groupBy("root").agg(F.max("root_size").alias("size"), F.max("gain").alias("gain"), F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"))
    about = lambda doc, k: groups.select(F.col("root").alias(doc), F.col("size").alias("n" + doc), *[F.col(c).alias(c + k) for c in ("gain", "n", "low", "high", "least", "most")])
    pairs = pairs.join(about("a", "1"), "a").join(about("b", "2"), "b")
    # of two prefixes the one that ends first in the order has all the common n-grams up to there, so that many are common
    # to both at least; what is common to two members is common to their roots' lists
    beyond = lambda c: F.ceil(F.col(c) * rule.num / F.lit(rule.den)) - 1
    pairs = pairs.where(F.col("common") >= rule.needed(F.col("least1"), F.col("least2")) - F.greatest(beyond("most1"), beyond("most2")))
    ends = [x + k for k in "12" for x in ("gain", "n", "low", "high")]
    pairs = tables.kept(pairs.select("a", "b", "na", "nb", rule.ceil(-F.col("gain1") - F.col("gain2")).alias("need"), *ends))
    counted = _compared(base, pairs, n, levels, tables)
    reached = F.col("overlap") * rule.unit >= (F.col("na") + F.col("nb")) * rule.num
    links = counted.where(reached).select("a", "b")
    # then members of one root with the other root
    roots = counted.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("na").alias("np"), F.col("nb").alias("nq"), (F.col("overlap") * rule.unit).alias("units"), *ends)

    def members(mine: str, other: str, k: str, l: str) -> DataFrame:
        m = homes.where("doc <> root").select(F.col("root").alias(mine), "doc", "size", "gain", "component")
        rows = roots.where(F.col("n" + k) > 1).join(m, mine).where(F.col("units") + F.col("gain") + F.col("gain" + l) >= 0).where(f"not (low{l} = high{l} and low{l} = component)")
        need = rule.ceil(F.col("size") * rule.num - F.col("gain" + l)).alias("need")
        return rows.select(F.col("doc").alias("a"), F.col(other).alias("b"), F.col("size").alias("na"), F.col("n" + other).alias("nb"), need, "p", "q", "gain", "component")

    one = tables.kept(members("p", "q", "1", "2").union(members("q", "p", "2", "1")))
    if one.limit(1).count() == 0:
        return links
    counted = _compared(base, one, n, levels, tables)
    links = links.union(counted.where(reached).select("a", "b"))
    # and members of both, where what each shares with the other's root and all that the other has besides could do
    side = lambda root, k: counted.where(F.col("b") == F.col(root)).select("p", "q", *[F.col(c).alias(c + k) for c in ("a", "na", "gain", "component")], (F.col("overlap") * rule.unit - F.col("na") * rule.num).alias("units" + k))
    both = side("q", "1").join(side("p", "2"), ["p", "q"]).where("component1 <> component2 and units1 + gain2 >= 0 and units2 + gain1 >= 0")
    both = both.where(rule.near(F.least("na1", "na2"), F.greatest("na1", "na2")))
    both = both.select(F.col("a1").alias("a"), F.col("a2").alias("b"), F.col("na1").alias("na"), F.col("na2").alias("nb"), rule.needed(F.col("na1"), F.col("na2")).alias("need"))
    both = tables.kept(both)
    if both.limit(1).count() == 0:
        return links
    return links.union(_compared(base, both, n, levels, tables).select("a", "b"))


def _with_digest(docs: DataFrame, n: int) -> DataFrame:
    """docs with _size, _d1 and _d2: the digest of each text's set."""
    more = [StructField(x, LongType()) for x in ("_size", "_d1", "_d2")]
    schema = StructType([*docs.schema.fields, *more])
    names = schema.names
    at = names.index("text")

    def run(batches):
        for batch in batches:
            sets = [(len(s), *_digest(s)) for s in document_sets(*text_buffers(batch.column(at)), n)]
            digest = [pa.array(np.array([s[0] for s in sets], np.int64)), *(pa.array(_signed([s[k] for s in sets])) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *digest], names)

    return docs.mapInArrow(lean(run), schema)


def kept(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """docs without all but the smallest doc_id of each component; of repeated rows of that id one stays; null ids stay.

    Of an id with several texts each text is a document, so one of them stays for each component that the id is the smallest of.
    """
    sets, named, repeats = _labelled(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), n, threshold, 27)
    first = named.groupBy("component").agg(F.min(F.struct("rep", "size", "d1", "d2")).alias("p")).select(F.col("p.rep").alias("doc_id"), *[F.col(f"p.{x}").alias(f"_{x}") for x in ("size", "d1", "d2")])
    empty = sets.where("size = 0 and doc_id is not null").select("doc_id", *[F.col(x).alias(f"_{x}") for x in ("size", "d1", "d2")])
    if repeats:
        key = ["doc_id", "_size", "_d1", "_d2"]
        stay = _with_digest(docs, n).join(first.union(empty), key, "left_semi").dropDuplicates(key).select(*docs.columns)
    else:
        stay = docs.join(first.union(empty).select("doc_id"), "doc_id", "left_semi")
    return stay.unionByName(docs.where("doc_id is null"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL
), one AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), l AS (
  SELECT a, b FROM one UNION ALL SELECT b, a FROM one
), r(doc_id, c) AS (
  SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
), m AS (
  SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
