"""N-gram Jaccard join by grouped prefix filtering.

A document's set holds the distinct hashes (64 bits) of its n-word shingles.
Sets are ordered by one global order, rarer first, taken from a fixed-size
table of shingle counts over all documents. Documents with equal sets form a
class; classes with the same size and the same prefix (the part of the order
that any partner must meet) form a group. Only groups enter the token index.
Group pairs that share a prefix token are filtered by size, position, a bitmap
of shingle parities and prefix overlap, expanded to their member classes, and verified on the texts.

Links are complete in the sense of components: pairs are first tried along
chains and stars within each token's groups; pairs whose ends those links already
connect need no test, every other candidate pair is then tested. No pair of a
token is written out while its ends are known to be connected, so a large
group of near copies costs rows in proportion to its size. The list of a token
that the shingle counts call hot is dealt to parts by a salt; chains and stars
run in each part, and along the first ones of the parts.

Defined cases: a null or empty text, or one without words, has an empty set,
is linked with nothing and is its own component. A text with fewer than n words
has its whole sequence as the one shingle. Equal texts, repeated rows and ties
share a component through their class. A doc_id with several texts is one
document: whatever any of them is linked to is in its component. A null doc_id
takes no part (n_shingles is given, component_id is null). Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, components, prepare, release, shingle_sets, small_side, text_slices, tidy

N, NUM, DEN = 5, 80, 100
#: Counters of the global order: a fixed table of 4 MB, whatever the corpus.
ORDER_BITS, ORDER_PART = 20, 14
#: A token's key holds the logarithm of its count in its upper bits.
_LOG_AT, _LOG_STEP = 47, 512
#: Shingles counted for each part that a hot token's list is dealt to.
LIST = 200_000


def _count(n: int):
    """Adds up shingles by the top bits of their hash; each task gives its table once, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for _, _, data, off in text_slices(batch.column(0)):
                sets = shingle_sets(data, off, n)
                total += np.bincount((np.concatenate(sets) >> U64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))
        parts = total.reshape(-1, 1 << ORDER_PART)
        full = [k for k in range(len(parts)) if parts[k].any()]
        if full:
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([parts[k].tobytes() for k in full], pa.binary())], names=["part", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up one part over all tasks, batch by batch."""
    total, part = np.zeros(1 << ORDER_PART, np.int64), None
    for batch in batches:
        part = batch.column(0).slice(0, 1)
        for x in batch.column(1):
            total += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.record_batch([part, pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def order_table(docs: DataFrame, n: int) -> np.ndarray:
    """For each of 2**ORDER_BITS hash ranges, the logarithm of its shingles over all documents, as 15 bits."""
    rows = docs.select("text").mapInArrow(tidy(_count(n)), "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for r in rows:
        total[r["part"] << ORDER_PART : (r["part"] + 1) << ORDER_PART] = np.frombuffer(r["counts"], np.int64)
    return (np.log2(total + 1.0) * _LOG_STEP).astype(np.uint16)


def _least(size, num: int, den: int):
    """The least overlap that a set of this size needs with any partner."""
    return -(-size * num // den)


def _features(n: int, num: int, den: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value.astype(U64)
        for batch in batches:
            sizes, high, low, prefixes, maps = [], [], [], [], []
            for _, _, data, off in text_slices(batch.column(1)):
                for h in shingle_sets(data, off, n):
                    size = len(h)
                    sizes.append(size)
                    maps.append(np.packbits(np.bincount((h & U64(255)).astype(np.int64), minlength=256) & 1).view("<i8"))
                    if not size:
                        high.append(0)
                        low.append(0)
                        prefixes.append(np.zeros(0, np.int64))
                        continue
                    high.append(int((h * U64(0x9FB21C651E98DF25) + U64(1)).sum()) - (1 << 63))
                    low.append(int(np.bitwise_xor.reduce(h * h + U64(0x632BE59BD9B4E019))) - (1 << 63))
                    p = size - _least(size, num, den) + 1
                    key = (table[h >> U64(64 - ORDER_BITS)] << U64(_LOG_AT)) | ((h & U64((1 << 60) - 1)) >> U64(13))
                    if p < size:
                        key = np.partition(key, p - 1)[:p]
                    key.sort()
                    prefixes.append(key.astype(np.int64))
            off = np.zeros(len(prefixes) + 1, np.int32)
            np.cumsum([len(x) for x in prefixes], out=off[1:])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(off, pa.array(flat)), pa.array(list(maps), pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "high", "low", "prefix", "odd"])

    return run


def _verify(n: int, num: int, den: int):
    """Keeps pairs (a, b, text_a, text_b) with den * |A and B| >= num * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sets = [[h for _, _, data, off in text_slices(batch.column(k)) for h in shingle_sets(data, off, n)] for k in (2, 3)]
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) and den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _prefix_overlap(num: int, den: int):
    """Keeps pairs whose prefixes leave enough possible overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n1, n2 = (batch.column(k).to_numpy() for k in (2, 3))
            cols = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(4), batch.column(5))]
            need = -(-(n1 + n2) * num // (num + den))
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in cols)
                end = min(x[-1], y[-1])
                x_end, y_end = np.searchsorted(x, end, side="right"), np.searchsorted(y, end, side="right")
                both = len(np.intersect1d(x[:x_end], y[:y_end]))
                if both + min(n1[i] - x_end, n2[i] - y_end) >= need[i]:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


class JaccardJoin:
    """The join over one documents table; see the module."""

    def __init__(self, docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN):
        self.spark, self.n, self.num, self.den = prepare(docs.sparkSession), n, num, den
        self.docs = docs.select("doc_id", "text")
        order = self.spark.sparkContext.broadcast(order_table(docs, n))  # 2 MB, whatever the corpus
        kind = "doc_id long, n_shingles long, high long, low long, prefix array<long>, odd array<long>"
        self.features = self.docs.mapInArrow(tidy(_features(n, num, den, order)), kind).checkpoint()
        order.destroy()
        classes = self.features.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "high", "low").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"))
        self.classes = classes.withColumn("gid", F.min("rep").over(Window.partitionBy("n_shingles", F.xxhash64("prefix"), "prefix"))).checkpoint()
        self.groups = self.classes.where("rep = gid").select("gid", "n_shingles", "prefix")
        self.tokens = self.groups.select("gid", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("i", "token"))

    def links(self) -> DataFrame:
        """Linked pairs (a, b) of class representatives that connect every component; see the module."""
        release(self.spark)
        first = self._chains()
        linked = self._verified(first).checkpoint()
        release(self.spark)
        label = self._labels(linked)
        # no name for the pairs here, so that their shuffles can go once they are checkpointed
        found = self._verified(self._unconnected(label).join(first, ["a", "b"], "left_anti"))
        every = linked.union(found).checkpoint()
        release(self.spark)
        same = self._same_ids()
        return every if same is None else every.union(same)

    def _same_ids(self) -> DataFrame | None:
        """Links between the classes of a doc_id that has several texts; None if there is no such id."""
        key = ["n_shingles", "high", "low"]
        some = self.features.where("n_shingles > 0 and doc_id is not null")
        several = some.groupBy("doc_id").agg(F.min("high").alias("x"), F.max("high").alias("y")).where("x <> y").select("doc_id").checkpoint()
        if several.isEmpty():
            return None
        of = some.select("doc_id", *key).join(several, "doc_id", "left_semi").join(self.classes.select(*key, "rep"), key).select("doc_id", "rep").distinct()
        return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))

    def _chains(self) -> DataFrame:
        """Each group with the one before it and the first one in its tokens' lists, and each class with the one before it in its group.

        Lists are ordered by the token's place in the prefix: a document with
        few rare shingles, one near the source of its copies, stands early.
        """
        other = F.struct("gid", "n", "i")
        count = F.pow(F.lit(2.0), F.shiftright("token", _LOG_AT) / _LOG_STEP)  # at least that of the token
        parts = 1 + F.floor(count / LIST)
        salted = self.tokens.withColumn("salt", F.pmod(F.xxhash64("gid"), parts).cast("int"))

        def beside(list_: DataFrame, *key: str) -> DataFrame:
            by = Window.partitionBy(*key).orderBy("i", "n", "gid")
            return list_.select("token", "gid", "n", "i", F.lag(other).over(by).alias("p"), F.first(other).over(by).alias("q"))

        # lists in one part need no second pass along their first ones
        heads = beside(salted.where(parts > 1), "token", "salt").where("p is null")
        seen = beside(salted, "token", "salt").union(beside(heads, "token")).where("p is not null")
        near = seen.select("gid", "n", "i", F.explode(F.array_distinct(F.array("p", "q"))).alias("p"))
        need = F.ceil((F.col("n") + F.col("p.n")) * self.num / (self.num + self.den))
        alike = F.least("n", "p.n") * self.den >= F.greatest("n", "p.n") * self.num
        near = near.where(alike & (F.least(F.col("n") - F.col("i"), F.col("p.n") - F.col("p.i")) >= need))
        across = near.select(F.least("gid", "p.gid").alias("a"), F.greatest("gid", "p.gid").alias("b")).distinct()
        within = self.classes.select(F.lag("rep").over(Window.partitionBy("gid").orderBy("rep")).alias("a"), F.col("rep").alias("b")).where("a is not null and a <> b")
        return self._overlapping(across).union(within).checkpoint()

    def _labels(self, linked: DataFrame) -> DataFrame:
        """(rep, label) of linked classes: classes with one label are connected by links."""
        both = linked.union(linked.select("b", "a"))
        label = both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("m")).select("rep", F.least("rep", "m").alias("label")).checkpoint()
        for _ in range(3):  # each pass doubles the length of the paths that a label has followed
            hop = label.select(F.col("rep").alias("label"), F.col("label").alias("next"))
            label = label.join(hop, "label", "left").select("rep", F.coalesce("next", "label").alias("label")).checkpoint()
        return label

    def _unconnected(self, label: DataFrame) -> DataFrame:
        """All candidate pairs of classes whose labels differ."""
        member = self.classes.select("rep", "gid").join(label, "rep", "left").select("rep", "gid", F.coalesce("label", "rep").alias("label")).checkpoint()
        spread = member.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).checkpoint()
        t = self.groups.join(spread, "gid").select("gid", "lo", "hi", F.posexplode("prefix").alias("i", "token"))
        # a token whose groups all bear one label has nothing to pair
        of = Window.partitionBy("token")
        t = t.select("*", F.min("lo").over(of).alias("x"), F.max("hi").over(of).alias("y")).where("x <> y").drop("x", "y")
        t = t.withColumn("one", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
        about = self.classes.where("rep = gid").select("gid", F.col("n_shingles").alias("n"), "odd").join(spread.select("gid", "size"), "gid")
        t = t.join(about, "gid").withColumn("odd", F.when(F.col("size") == 1, F.col("odd"))).checkpoint()
        x, y = t.alias("x"), t.alias("y")
        need = F.ceil((F.col("x.n") + F.col("y.n")) * self.num / (self.num + self.den))
        can = F.col("x.n") * self.den >= F.col("y.n") * self.num
        ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.gid") < F.col("y.gid")))
        reach = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
        can &= F.col("x.odd").isNull() | F.col("y.odd").isNull() | (self._differ("x.odd", "y.odd") <= F.col("x.n") + F.col("y.n") - 2 * need)
        apart = F.col("x.one").isNull() | F.col("y.one").isNull() | (F.col("x.one") != F.col("y.one"))
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & ordered & can & apart & (reach >= need)).select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b")).distinct()
        pairs = self._overlapping(pairs)
        one, two = member.alias("one"), member.alias("two")
        across = pairs.join(one, F.col("a") == F.col("one.gid")).join(two, F.col("b") == F.col("two.gid"))
        apart = F.col("one.label") != F.col("two.label")
        ends = F.least("one.rep", "two.rep").alias("a"), F.greatest("one.rep", "two.rep").alias("b")
        return across.where(apart).select(*ends).union(self._inside(member, spread).select(*ends))

    def _inside(self, member: DataFrame, spread: DataFrame) -> DataFrame:
        """Pairs one, two of classes of a group whose labels and, as far as their parity maps tell, contents may be linked."""
        split = spread.where("lo <> hi").select("gid").checkpoint()
        own = member.join(small_side(split, split.count()), "gid", "left_semi").join(self.classes.select("rep", "gid", "odd", F.col("n_shingles").alias("n")), ["rep", "gid"])
        one, two = own.alias("one"), own.alias("two")
        need = F.ceil(F.col("one.n") * 2 * self.num / (self.num + self.den))
        can = self._differ("one.odd", "two.odd") <= F.col("one.n") * 2 - 2 * need
        return one.join(two, (F.col("one.gid") == F.col("two.gid")) & (F.col("one.rep") < F.col("two.rep")) & (F.col("one.label") != F.col("two.label")) & can)

    @staticmethod
    def _differ(x: str, y: str):
        """The bits in which two parity maps differ: sets that differ in m shingles differ in at most m of them."""
        return sum(F.bit_count(F.element_at(x, k).bitwiseXOR(F.element_at(y, k))) for k in range(1, 5))

    def _overlapping(self, pairs: DataFrame) -> DataFrame:
        g = self.groups
        wide = pairs.join(g.select(F.col("gid").alias("a"), F.col("n_shingles").alias("n1"), F.col("prefix").alias("p1")), "a").join(g.select(F.col("gid").alias("b"), F.col("n_shingles").alias("n2"), F.col("prefix").alias("p2")), "b")
        return wide.select("a", "b", "n1", "n2", "p1", "p2").mapInArrow(tidy(_prefix_overlap(self.num, self.den)), "a long, b long")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.checkpoint()
        release(self.spark)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().checkpoint()
        # all texts of an id, each once: a pair is linked if any of them are
        text = self.docs.join(small_side(ids, ids.count()), "doc_id", "left_semi").repartition("doc_id").dropDuplicates(["doc_id", "text"])
        one, two = text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(_verify(self.n, self.num, self.den)), "a long, b long")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of documents."""
        found = components(self.links())
        rep = self.classes.select("n_shingles", "high", "low", "rep").join(found, F.col("rep") == F.col("node"), "left")
        rep = rep.select("n_shingles", "high", "low", F.coalesce("component", "rep").alias("component_id"))
        out = self.features.select("doc_id", "n_shingles", "high", "low").join(rep, ["n_shingles", "high", "low"], "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, *, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for every document."""
    return JaccardJoin(docs, n, num, den).result()


def keep_one(docs: DataFrame, *, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component: of its least doc_id, the first by its columns; all rows without words.

    Here rows with a null doc_id take part, after all others: of those that are
    linked with nothing else, one of each text stays.
    """
    first, by_id = docs.columns, docs
    if not docs.where("doc_id is null").isEmpty():  # ids of their own, by text
        own = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
        by_id = docs.withColumn("__null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", own))
    found = jaccard_components(by_id, n=n, num=num, den=den)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct().checkpoint()
    out = by_id.join(small_side(gone, gone.count()), "doc_id", "left_anti")
    again = found.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    if (rows := again.count()) > 0:
        words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        repeated = out.join(small_side(again.withColumn("__again", F.lit(True)), rows), "doc_id", "left").withColumn("__again", F.coalesce("__again", F.lit(False)) & words)
        one = repeated.where("__again").withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in first if c != "doc_id")))).where("__k = 1")
        out = repeated.where("not __again").select(*out.columns).union(one.select(*out.columns))
    if by_id is not docs:
        out = out.withColumn("doc_id", F.when(~F.col("__null"), F.col("doc_id")))
    return out.select(*first)
