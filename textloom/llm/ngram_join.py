"""Exact Jaccard self-join of documents' word shingles as a metric-space join.

Jaccard distance is a metric, so pivots split the documents into Voronoi regions, and a document has to be present in
every region into which one of its neighbours can fall. Two kinds of pivots are used, one inside the other:

* singletons {e} of a shingle. The nearest are a document's own shingles, ties go to the rarest first. Of two documents
  within distance r, each holds enough of the other's shingles that one of the first n - ceil((1 - r) n) + 1 pivots is
  common to both; with that window every document is replicated to just these regions. The place of the pivot among a
  document's shingles bounds the set sizes of the neighbours that it can meet first in this region (``most``): two
  documents need to meet only where each is no larger than the other's bound, and whoever can meet nobody leaves.
* documents, within such regions. Each region takes as pivot the member with most room below its bound, which tends to lie in the
  middle; each document is measured exactly against the pivot that it shares most regions with. Members within r join
  it. Regions that still hold several classes recurse with another pivot, as long as this brings links. In what remains,
  the members outside of a region's largest class meet its others where the bounds and the triangle
  inequality over their pivot (|d(x, p) - d(y, p)| <= r) leave it open, and are measured exactly.

So a group of near copies costs about one pair for each of its documents and not one for each two of them. Documents
with the same shingle set are one class from the start. Rarity comes from counts of all documents' shingles in a
fixed number of buckets, so very common passages come last and create no large regions.

Defined results: null texts and texts without words have an empty set and are linked with nothing; with fewer
words than a shingle, the whole sequence is one shingle; rows that repeat id and text are one document and come out
alike; an id must not stand for different texts (its links are then those of one of them); null ids take no part in links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, freeing, settle
from textloom.llm.components import components
from textloom.llm.words import SPACES, batches_of_words, mix

BUCKETS = 1 << 18
CHUNK = 1 << 12


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, sorted distinct shingle numbers) of consecutive rows."""
    for row, bounds, number in batches_of_words(texts, SPACES):
        count = np.diff(bounds)
        doc = np.repeat(np.arange(len(count)), count)
        long = np.flatnonzero(np.arange(len(number)) + words <= bounds[1:][doc]) if len(number) else np.zeros(0, np.int64)
        key = np.zeros(len(long), np.uint64)
        for k in range(words):
            key = mix(key * np.uint64(3) + number[long + k])
        own = doc[long]
        for d in np.flatnonzero((count > 0) & (count < words)):
            whole = np.zeros(1, np.uint64)
            for x in number[bounds[d] : bounds[d + 1]]:
                whole = mix(whole * np.uint64(3) + x)
            key, own = np.append(key, mix(whole + np.uint64(count[d]))), np.append(own, d)
        order = np.lexsort((key, own))
        key, own = key[order], own[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        key, own = key[new], own[new]
        yield row, np.searchsorted(own, np.arange(len(count) + 1)), key


@freeing
def _keys_and_counts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """For each document its id, set size and a 128-bit key of the set; then, by chunks, how many sets have a shingle in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        for row, bounds, key in shingle_sets(batch.column(1), words):
            n = np.diff(bounds)
            total += np.bincount((key & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(key + np.uint64(1)), mix(key ^ np.uint64(0x5851F42D4C957F2D)))]
            sums = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
            nothing = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), *nothing], schema=schema)
    m = BUCKETS // CHUNK
    none = pa.nulls(m, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(m, dtype=np.int32)), pa.array([total[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(m)], pa.binary())], schema=schema)


def _add_counts(pdf):
    return pdf.head(1).assign(counts=[np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0).tobytes()])


@freeing
def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, rarity) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, pivots): the window of nearest singleton pivots, rarest first."""
    order_of = rarity.value
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("pivots", pa.list_(pa.int64()))])
    for batch in batches:
        for row, bounds, key in shingle_sets(batch.column(1), words):
            n = np.diff(bounds)
            own = np.repeat(np.arange(len(n)), n)
            by_rarity = np.lexsort((key, order_of[(key & np.uint64(BUCKETS - 1)).astype(np.int64)], own))
            place = np.arange(len(key)) - bounds[own]
            window = n - -(-percent * n // 100) + 1
            kept = by_rarity[place < window[own]]
            size = np.minimum(window, n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(key[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), lists], schema=schema)


@freeing
def _sets(batches: Iterator[pa.RecordBatch], words: int, asked) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles) of the documents whose hash is marked among those asked for, each once in a task."""
    bits, seen = asked.value, set()
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        slot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        batch = batch.filter(pa.array(bits[slot]))
        ids = batch.column(0).to_pylist()
        new = [i not in seen and not seen.add(i) for i in ids]
        batch = batch.filter(pa.array(new, pa.bool_()))
        for row, bounds, key in shingle_sets(batch.column(1), words):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(bounds) - 1), lists], schema=schema)


def _slot(column, size: int):
    return F.pmod(F.xxhash64(column), F.lit(size))


def _bitmap(ids: DataFrame, size: int = 1 << 23) -> np.ndarray:
    """``size`` bits, at most 2^28: where a doc_id's hash falls that is among ``ids``. A filter that decides nothing."""
    slot = _slot("doc_id", size) + 1  # Spark counts positions from 1
    rows = ids.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(size, bool)
    for r in rows.collect():  # 4 KB each
        out[(r.k - 1) * 32768 : r.k * 32768] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
    return out


@freeing
def _maybe_shared(batches: Iterator[pa.RecordBatch], bits, percent: int) -> Iterator[pa.RecordBatch]:
    """The windows without the pivots whose bit isn't set; ``most`` is the largest set that a document can meet first at the pivot.

    Documents of n and m shingles that are linked have t = ceil(p (n + m) / (100 + p)) in common, so their first common
    one is at place n - t of the former or before: m <= (n - place) (100 + p) / p - n."""
    packed = bits.value
    for batch in batches:
        slots = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        hit = (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
        lists, n = batch.column(2), batch.column(1).to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        own = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        most = ((n[own] - place) * (100 + percent) // percent - n[own])[hit]
        bounds = pa.array(np.searchsorted(own[hit], np.arange(len(sizes) + 1)).astype(np.int32))
        kept = pa.ListArray.from_arrays(bounds, lists.flatten().filter(pa.array(hit)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, pa.ListArray.from_arrays(bounds, pa.array(most))], names=["doc_id", "n", "pivots", "most"])


class JaccardJoin:
    """Runs the steps over one table; ``heads``, ``links`` and ``labels`` are the results."""

    def __init__(self, docs: DataFrame, percent: int = 80, words: int = 5, id_col="doc_id", text_col="text"):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.percent, self.words, self.spark = percent, words, docs.sparkSession
        self._classes()
        self._regions()
        self._link()

    def _classes(self) -> None:
        words = self.words
        made = settle(self.docs.mapInArrow(lambda x: _keys_and_counts(x, words), "doc_id long, n long, k1 long, k2 long, chunk int, counts binary"), "shingle-keys")
        counts = made.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(_add_counts, "chunk int, counts binary")
        self.rarity = np.zeros(BUCKETS, np.int64)
        for r in counts.collect():  # a fixed number of buckets
            self.rarity[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
        self.sizes = made.where("chunk is null").select("doc_id", "n", "k1", "k2")
        known = self.sizes.where("doc_id is not null and n > 0")
        # a third of all documents may have one set: map-side combining leaves one row for it and task
        self.heads = settle(known.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("head")), "set-heads")

    def _regions(self) -> None:
        words, percent = self.words, self.percent
        rarity = self.spark.sparkContext.broadcast(self.rarity)
        made = self.docs.where("doc_id is not null").mapInArrow(lambda x: _prefixes(x, words, percent, rarity), "doc_id long, n long, pivots array<long>")
        made = settle(made, "pivot-windows")
        rarity.destroy()
        # most shingles are one document's alone: their regions go before anything but their number is shuffled
        shared = made.select(F.explode("pivots").alias("region")).groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
        shared = settle(shared, "shared-regions")
        size = 1 << min(28, max(15, (16 * shared.count()).bit_length()))
        bits = self.spark.sparkContext.broadcast(np.packbits(_bitmap(shared.select(F.col("region").alias("doc_id")), size), bitorder="little"))
        slots = made.withColumn("slots", F.transform("pivots", lambda p: _slot(p, size).cast("int")))
        near = slots.mapInArrow(lambda x: _maybe_shared(x, bits, percent), "doc_id long, n long, pivots array<long>, most array<long>")
        near = near.join(self.heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        near = near.select("doc_id", "n", F.explode(F.arrays_zip(F.col("pivots").alias("region"), F.col("most").alias("most"))).alias("p")).select("doc_id", "n", "p.region", "p.most")
        members = settle(near, "regions")
        bits.destroy()
        # who is too large for all others of the region, or finds all of them too large, meets nobody there
        bounds = members.groupBy("region").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("most").alias("high")).where("members > 1")
        kept = members.join(bounds, "region").where("most >= low and n <= high").select("region", "doc_id", "n", "most")
        self.members = settle(kept, "region-members")
        discard(made, shared, members)

    def _distances(self, pairs: DataFrame, name: str, few: int = 500_000) -> DataFrame:
        """pairs(a, b, na, nb) -> (a, b, near, distance), exactly. Only sets of documents in the pairs leave the map over the texts."""
        pairs, words = settle(pairs.select("a", "b", "na", "nb"), "pairs"), self.words
        ids = settle(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
        asked = self.spark.sparkContext.broadcast(_bitmap(ids))
        rows = self.docs.where("doc_id is not null").withColumn("slot", _slot("doc_id", 1 << 23))
        sets = rows.mapInArrow(lambda x: _sets(x, words, asked), "doc_id long, shingles array<long>")
        small = ids.count() <= few  # a checked bound
        sets = settle(sets.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"), "shingle-sets")
        asked.destroy()
        left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        # a set goes to its pair without a shuffle and then once to the pair's other document; of those only their own sets move
        few_pairs = small and pairs.count() <= few
        other = pairs.select("b").distinct()
        right = right.join(F.broadcast(other) if small else other, "b", "left_semi")
        met = left.join(F.broadcast(pairs) if few_pairs else pairs, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
        union = F.col("na") + F.col("nb") - F.col("shared")
        made = met.select("a", "b", (100 * F.col("shared") >= self.percent * union).alias("near"), (1 - F.col("shared") / union).alias("distance"))
        made = settle(made.dropDuplicates(["a", "b"]), name)  # rows that repeat an id
        discard(pairs, ids, sets)
        return made

    def _open(self, members: DataFrame, label: DataFrame | None) -> DataFrame:
        """The members of the regions that still hold several classes, each with its class; ``major`` is its region's largest class."""
        rows = members.select("region", "doc_id", "n", "most")
        if label is None:
            return rows.withColumns({"component": F.col("doc_id"), "major": F.lit(None).cast("long")})
        own = rows.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        classes = own.groupBy("region", "component").agg(F.count("*").alias("size")).groupBy("region").agg(F.count("*").alias("classes"), F.max(F.struct("size", "component"))["component"].alias("major"))
        return settle(own.join(classes.where("classes > 1").select("region", "major"), "region").select("region", "doc_id", "n", "most", "component", "major"), "open-members")

    def _pivot_pairs(self, members: DataFrame, tested: DataFrame | None, k: int) -> DataFrame:
        """(a, b, na, nb): each document and the one pivot of another class that it shares most regions with and wasn't measured against."""
        one = F.struct("doc_id", "n", "most", "component")
        order = F.struct((F.col("most") - F.col("n")) / F.col("n"), F.xxhash64("doc_id")) if k == 0 else F.struct(F.col("most") >= F.col("n"), F.xxhash64("doc_id", F.lit(k)))
        pivots = members.groupBy("region").agg(F.max_by(one, order).alias("p"))
        met = members.join(pivots, "region").where("component <> p.component and most >= p.n and n <= p.most")
        votes = met.groupBy(F.col("doc_id").alias("a"), F.col("p.doc_id").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb")).agg(F.count("*").alias("votes"))
        if tested is not None:
            votes = votes.join(tested, ["a", "b"], "left_anti")
        return votes.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("votes", -F.col("b"))).alias("p")).select("a", "p.b", "na", "p.nb")

    def _link(self, least_share: int = 20) -> None:
        """Rounds of pivots go on while more than one test in ``least_share`` brings a link; then all open pairs are measured.

        Classes only grow, so a region that holds one class is closed for good."""
        members, label, cells, made = self._open(self.members, None), None, None, []
        while True:
            flat = reduce(DataFrame.unionByName, made) if made else None
            tested = flat and flat.select("a", "b").unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
            made.append(self._distances(self._pivot_pairs(members, tested, len(made)), "pivot-distances"))
            cells = made[0].select(F.col("a").alias("doc_id"), F.col("b").alias("cell"), "distance")
            tests, found = made[-1].agg(F.count("*"), F.count_if("near")).first()
            if found:
                label = components(reduce(DataFrame.unionByName, made).where("near").select("a", "b"))
                members, before = self._open(members, label), members
                discard(before)
            if found * least_share <= tests:
                break
        flat = reduce(DataFrame.unionByName, made)
        tested = flat.select("a", "b").unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        x = members.where("component <> major").join(cells, "doc_id", "left")
        y = members.join(cells, "doc_id", "left")
        y = y.select("region", *(F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "most", "component", "major", "cell", "distance")))
        r = 1 - self.percent / 100 + 1e-9
        apart = (F.col("cell") == F.col("cell_y")) & (F.abs(F.col("distance") - F.col("distance_y")) > r)
        once = (F.col("component_y") == F.col("major_y")) | (F.col("doc_id") < F.col("doc_id_y"))
        fits = (F.col("component") != F.col("component_y")) & (F.col("most") >= F.col("n_y")) & (F.col("most_y") >= F.col("n"))
        met = x.drop("major").join(y, "region").where(once & fits & ~F.coalesce(apart, F.lit(False)))
        low = F.col("doc_id") < F.col("doc_id_y")
        pairs = met.select(F.least("doc_id", "doc_id_y").alias("a"), F.greatest("doc_id", "doc_id_y").alias("b"), F.when(low, F.col("n")).otherwise(F.col("n_y")).alias("na"), F.when(low, F.col("n_y")).otherwise(F.col("n")).alias("nb"))
        made.append(self._distances(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pair-distances"))
        self.links = reduce(DataFrame.unionByName, made).where("near").select("a", "b")
        self.labels = components(self.links) if made[-1].where("near").limit(1).count() or label is None else label
        discard(members)

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document."""
        head = self.sizes.join(self.heads, ["n", "k1", "k2"], "left").select("doc_id", "n", "head")
        out = head.join(self.labels.withColumnRenamed("node", "head"), "head", "left")
        linked = F.when(F.col("n") > 0, F.coalesce("component", "head"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(linked, "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = 80, words: int = 5, **columns) -> DataFrame:
    return JaccardJoin(docs, percent, words, **columns).result()


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with the smallest id of their component, all their columns; null ids stay."""
    found = jaccard_components(docs, percent, words, id_col=id_col, text_col=text_col)
    gone = settle(found.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    return docs.join(gone, id_col, "left_anti")
