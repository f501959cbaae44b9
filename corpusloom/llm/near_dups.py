"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of five words (a shorter one is a single shingle). A shingle's weight is its count in
the text times a damped inverse document frequency; document frequencies come from a count-min sketch over all documents.
What counts is the share of documents that hold a shingle, down to RARE; the sketch's error, as a share of documents, is
the mean number of shingles of a text / WIDTH, so weights come out alike in a small and in a large corpus.

BANDS * ROWS consistent weighted samples make BANDS keys; texts that share a key are candidates. Exact copies count as one
text from the start. A bucket's texts first meet its least text, which joins most classes at one pair for each text. In
the buckets that still hold several classes every text is then compared with every text of another class: BLOCK texts and
BLOCK others meet in one group, which finds what all of them share by one product of matrices and gives a link for each two
classes at most; so no pair of a bucket is passed over, and no pairs are written out. Similarity is weighted Jaccard
similarity throughout; linked texts form classes.

Cases: a null text is an empty one; texts without words are near-duplicates of equal texts only; equal texts are one class
whatever their doc_id, null included; long texts are taken whole (a shingle's count in a text is kept up to 2 ** 20 - 1);
of the samples' ties the smaller hash counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keyed, table, text_key, unused, written
from .components import components
from .text_arrays import WORD_BYTES, chunks, hashes, lowered, mix, runs

#: Words of a shingle, similarity of near-duplicates, keys of a text, samples of a key.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 10, 3

#: How far rarity raises a weight: from 1 for a shingle of every text to 1 + IDF for one that a share of RARE or less holds.
IDF, RARE = 0.25, 1 / 512

#: Counters in each of the two rows of the sketch, blocks in which they travel, tasks whose blocks are added up together.
WIDTH, BLOCKS, FAN_IN = 1 << 20, 64, 1024

#: Texts of a block and columns of a product of matrices.
BLOCK, WIDE = 256, 4096

#: Bits of a shingle's hash that are kept, so that text and shingle, or shingle and count, fit into 64 bits.
_BITS, _COUNT = np.uint64(44), np.uint64(20)
_MOST = np.uint64((1 << 20) - 1)


def shingles(texts: list, n: int = WORDS):
    """Groups of whole texts: (number of the first text, how many, text of each shingle, shingle, its count), sorted."""
    for first, data, begins in chunks(texts):
        data = lowered(data)
        starts, ends = runs(WORD_BYTES[data])
        many = len(begins) - 1
        word = hashes(data, starts, ends)
        doc = np.searchsorted(begins, starts, "right") - 1
        total = np.bincount(doc, minlength=many)
        left = np.maximum(total - n + 1, np.minimum(total, 1))  # a shorter text makes one shingle of all its words
        begin = np.cumsum(total) - total
        place = np.repeat(begin - np.cumsum(left) + left, left) + np.arange(left.sum())
        owner = np.repeat(np.arange(many), left)
        last = np.append(begin + total, 0)[owner]
        h = np.full(len(place), 0x51ED27, np.uint64)
        padded = np.append(word, np.zeros(n, np.uint64))
        for k in range(n):
            h = np.where(place + k < last, mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[place + k]), h)
        both, count = np.unique(owner.astype(np.uint64) << _BITS | h >> (np.uint64(64) - _BITS), return_counts=True)
        yield first, many, (both >> _BITS).astype(np.int64), both & ((np.uint64(1) << _BITS) - np.uint64(1)), count


def _cells(shingle: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(shingle + np.uint64(0xD1F))
    return (h % np.uint64(width)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) % width


class Frequencies:
    """The sketch of the document frequencies of a corpus' shingles."""

    def __init__(self, counts: np.ndarray, documents: int):
        share = np.clip(counts / max(documents, 1), RARE, 1)
        self.weights = (1 + IDF * np.log(share) / np.log(RARE)).astype(np.float32)

    def weight(self, shingle: np.ndarray) -> np.ndarray:
        """The larger of the two cells' weights: the smaller count."""
        a, b = _cells(shingle, self.weights.shape[1])
        return np.maximum(self.weights[0][a], self.weights[1][b])


def frequencies(documents: DataFrame, width: int = WIDTH) -> Frequencies:
    """Of all shingles of documents(text). Tasks send blocks of counters, which are added up in a tree; the sum, 2 * WIDTH numbers whatever the corpus, comes to the driver."""

    def counted(batches):
        total, n = np.zeros((2, width), np.int32), 0
        for pdf in batches:
            n += len(pdf)
            for _, _, _, shingle, _ in shingles(pdf["text"].tolist()):
                for row, cell in enumerate(_cells(shingle, width)):
                    cell, many = np.unique(cell, return_counts=True)
                    total[row, cell] += many.astype(np.int32)
        task = TaskContext.get().partitionId()
        for row in range(2):
            for k, part in enumerate(np.split(total[row], BLOCKS)):
                if part.any():
                    yield pd.DataFrame({"task": [task], "row": [row], "block": [k], "counts": [part.astype(np.int64).tobytes()], "n": [0]})
        yield pd.DataFrame({"task": [task], "row": [-1], "block": [0], "counts": [b""], "n": [n]})
        give_back()

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pdf.iloc[:1].assign(task=pdf["task"].iloc[0] // FAN_IN, counts=[total.tobytes()], n=[pdf["n"].sum()])

    shape = "task int, row int, block int, counts binary, n long"
    found = documents.select("text").mapInPandas(counted, shape)
    found = found.groupBy("row", "block", F.floor(F.col("task") / FAN_IN)).applyInPandas(lambda pdf: summed(pdf), shape)
    found = found.groupBy("row", "block").applyInPandas(lambda pdf: summed(pdf), shape)
    counts, documents_n, size = np.zeros((2, width), np.int64), 0, width // BLOCKS
    for r in found.collect():
        if r["row"] < 0:
            documents_n = r["n"]
        else:
            counts[r["row"], r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return Frequencies(counts, documents_n)


class Sampler:
    """Consistent weighted samples. The quantiles of the gamma and the log-gamma distribution are tabulated."""

    STEPS = 1 << 16

    def __init__(self, samples: int = BANDS * ROWS):
        self.samples = samples
        u = (np.arange(self.STEPS) + 0.5) / self.STEPS
        x = np.full(self.STEPS, 1.0)
        for _ in range(60):  # quantiles of Gamma(2, 1): 1 - (1 + x) exp(-x) = u, by damped Newton steps
            x = np.clip(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 3, x * 3)
        self.gamma, self.log_gamma = x.astype(np.float32), np.log(x).astype(np.float32)

    def keys(self, many: int, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, bands: int = BANDS) -> list:
        """The band keys of each of `many` texts; none for texts without shingles."""
        if not len(owner):
            return [None] * many
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        log_w = np.log(weight).astype(np.float32)
        picks = []
        for k in range(self.samples):
            h = mix(shingle ^ np.uint64((k + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
            r = self.gamma[(h & np.uint64(0xFFFF)).astype(np.int32)]
            beta = ((h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 16)
            t = np.floor(log_w / r + beta)
            log_a = self.log_gamma[(h >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - beta) - r
            bits = log_a.view(np.uint32)
            order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # as the number, but unsigned
            name = (mix(h + t.astype(np.int64).astype(np.uint64)) >> np.uint64(32))
            picks.append(np.minimum.reduceat(order << np.uint64(32) | name, begin) & np.uint64(0xFFFFFFFF))
        rows = self.samples // bands
        made = np.empty((len(begin), bands), np.uint64)
        for b in range(bands):
            h = np.full(len(begin), b + 1, np.uint64)
            for p in picks[b * rows : (b + 1) * rows]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
            made[:, b] = h
        out: list = [None] * many
        for i, keys in zip(owner[begin].tolist(), made.view(np.int64), strict=True):
            out[i] = keys
        return out


def packed(texts: list, frequency: Frequencies):
    """The weight of each text and its shingles with their counts, sorted, as one array of 64-bit numbers."""
    for _, many, owner, shingle, count in shingles(texts):
        cut = np.searchsorted(owner, np.arange(many + 1))
        total = np.append(0, np.cumsum(count * frequency.weight(shingle).astype(float)))[cut]
        both = shingle << _COUNT | np.minimum(count.astype(np.uint64), _MOST)
        for i in range(many):
            yield total[i + 1] - total[i], both[cut[i] : cut[i + 1]]


def similar(a: np.ndarray, weight_a: float, b: np.ndarray, weight_b: float, frequency: Frequencies) -> float:
    """Weighted Jaccard similarity of two packed texts; 0 where one has no words."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b >> _COUNT, a >> _COUNT), len(b) - 1)
    hit = np.flatnonzero(b[at] >> _COUNT == a >> _COUNT)
    x, y = a[hit], b[at[hit]]
    both = float((np.minimum(x & _MOST, y & _MOST) * frequency.weight(x >> _COUNT).astype(float)).sum())
    return both / (weight_a + weight_b - both)


def similarity(texts: list, others: list, frequency: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of each text with its partner; 0 where one has no words."""
    return np.array([similar(a, v, b, w, frequency) for (v, a), (w, b) in zip(packed(texts, frequency), packed(others, frequency), strict=True)])


def linked(items: list[np.ndarray], weights: np.ndarray, roots: np.ndarray, frequency: Frequencies, threshold: float) -> list[tuple[int, int]]:
    """Of each two classes (numbers in roots) among some packed texts, one pair of texts that are similar enough, if there is one.

    What two texts share is a product of matrices: a column for each shingle and each of its occurrences that two texts have,
    WIDE columns at a time. A pair at the very threshold is decided by `similar`.
    """
    n = len(items)
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(n), [len(x) for x in items])
    count = (flat & _MOST).astype(np.int64)
    owner, shingle = np.repeat(owner, count), np.repeat(flat >> _COUNT, count)
    level = (np.arange(len(shingle)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    _, feature, many = np.unique(shingle << _COUNT | level, return_inverse=True, return_counts=True)
    use = np.flatnonzero(many[feature] > 1)
    use = use[np.argsort(feature[use], kind="stable")]
    owner, feature, w = owner[use], feature[use], frequency.weight(shingle[use])
    column = np.cumsum(np.append(True, feature[1:] != feature[:-1])[: len(use)]) - 1
    both = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(use) else 0, WIDE):
        part = slice(*np.searchsorted(column, [low, low + WIDE]))
        m = np.zeros((n, WIDE), np.float32)
        m[owner[part], column[part] - low] = 1
        scale = np.zeros(WIDE, np.float32)
        scale[column[part] - low] = w[part]
        both += (m * scale) @ m.T
    similar_to = both / (weights[:, None] + weights[None, :] - both)
    i, j = np.nonzero((similar_to >= threshold - 1e-4) & (roots[:, None] < roots[None, :]))
    order = np.argsort(-similar_to[i, j], kind="stable")
    i, j = i[order], j[order]
    _, first = np.unique(roots[i] * n + roots[j], return_index=True)
    return [(x, y) for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True) if similar_to[x, y] > threshold + 1e-4 or similar(items[x], weights[x], items[y], weights[y], frequency) >= threshold]


def _t(a: str, b: str, name: str) -> Column:
    return F.struct(F.col(a).alias("k1"), F.col(b).alias("k2")).alias(name)


def meetings(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed(band, key, t, root) -> band, key, t, root, low, high: the pairs of blocks in which the texts of a bucket meet those of other roots.

    A root of at least `block` texts of a bucket has blocks of its own, which don't meet one another; the other texts share
    blocks. So a crowd of one root meets the few texts beside it, not itself.
    """
    bucket, i = ["band", "key"], F.col("i")
    sizes = placed.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(*bucket)
    sizes = written(sizes.join(mixed, bucket).select(*bucket, "root", "n", F.when(F.col("n") >= block, F.col("root")).alias("own")), "roots-of-buckets")
    blocks = written(sizes.groupBy(*bucket, "own").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "blocks")  # own: null for shared blocks
    rows = placed.join(sizes.select(*bucket, "root", "own"), [*bucket, "root"])
    pure = F.struct(F.col("own").isNull().alias("shared"), "own").alias("of")  # unlike null, equal to itself
    rows = rows.select(*bucket, "t", "root", pure).join(blocks.select(*bucket, pure, F.col("blocks").alias("mine")), [*bucket, "of"])
    rows = rows.withColumn("here", F.xxhash64("of", F.pmod(F.xxhash64("t"), F.col("mine")))).drop("mine")
    others = blocks.select(*bucket, F.col("own").alias("other"), pure, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    others = others.select(*bucket, "other", F.xxhash64("of", i.cast("long")).alias("there"))
    met = rows.join(others, bucket).filter(F.col("of.shared") | F.col("other").isNull() | (F.col("of.own") != F.col("other")))
    return met.select(*bucket, "t", "root", F.least("here", "there").alias("low"), F.greatest("here", "there").alias("high"))


def near_classes(documents: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Each row of documents(doc_id, text): doc_id, k1, k2 (which stand for its text), class_id (the least doc_id of the class),
    c1, c2 (the text of that document; exactly one text stands for a class) and class_size (rows)."""
    spark = documents.sparkSession
    frequency = spark.sparkContext.broadcast(frequencies(documents))  # 2 * WIDTH numbers

    def banded(batches):
        sampler = Sampler()
        for pdf in batches:
            keys: list = []
            for _, many, owner, shingle, count in shingles(pdf["text"].tolist()):
                keys += sampler.keys(many, owner, shingle, count * frequency.value.weight(shingle))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "k1": pdf["k1"], "k2": pdf["k2"], "keys": keys})
        give_back()

    def weighed(batches):
        for pdf in batches:
            weights, items = zip(*packed(pdf["text"].tolist(), frequency.value), strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({"t1": pdf["t1"], "t2": pdf["t2"], "weight": weights, "items": [x.tobytes() for x in items]})
        give_back()

    kind = documents.schema["doc_id"].dataType
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *text_key(F.col("text")))
    # As a string, since numbers with nulls among them are floats in pandas.
    texts = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(banded, "doc_id string, k1 long, k2 long, keys array<long>").withColumn("doc_id", F.col("doc_id").cast(kind))
    own = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")
    texts = written(texts.groupBy("k1", "k2").agg(F.first("keys").alias("keys"), F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).select(_t("k1", "k2", "t"), "keys", "first", "n"), "texts")
    buckets = texts.select("t", F.posexplode("keys").alias("band", "key"))
    crowded = written(buckets.groupBy("band", "key").agg(F.min("t").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "key", "least"), "crowded")
    buckets = written(buckets.join(crowded, ["band", "key"]), "buckets")

    # The shingles of the candidates, from one row of each text.
    members = texts.join(buckets.select("t").distinct(), "t", "left_semi").select("t", F.struct("first.doc_id").alias("own"))
    bodies = rows.select(_t("k1", "k2", "t"), F.struct("doc_id").alias("own"), "text").join(members, ["t", "own"], "left_semi")
    bodies = bodies.select(F.col("t.k1").alias("t1"), F.col("t.k2").alias("t2"), "text").mapInPandas(weighed, "t1 long, t2 long, weight double, items binary")
    bodies = written(bodies.select(_t("t1", "t2", "t"), "weight", "items").dropDuplicates(["t"]), "bodies")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        def compared(batches):
            for pdf in batches:
                keep = [similar(np.frombuffer(a, np.uint64), v, np.frombuffer(b, np.uint64), w, frequency.value) >= threshold for a, v, b, w in zip(pdf["items_a"], pdf["weight_a"], pdf["items_b"], pdf["weight_b"], strict=True)]
                yield pdf.loc[np.array(keep, bool), ["a1", "a2", "b1", "b2"]]
            give_back()

        sides = [bodies.select(F.col("t").alias(s), F.col("weight").alias(f"weight_{s}"), F.col("items").alias(f"items_{s}")) for s in "ab"]
        both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").filter(F.least("weight_a", "weight_b") >= threshold * (1 - 1e-9) * F.greatest("weight_a", "weight_b"))
        both = both.select(F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2"), "weight_a", "items_a", "weight_b", "items_b")
        return written(both.mapInPandas(compared, "a1 long, a2 long, b1 long, b2 long").select(_t("a1", "a2", "a"), _t("b1", "b2", "b")), name)

    tested = written(buckets.filter("t <> least").select(F.col("least").alias("a"), F.col("t").alias("b")).distinct(), "pairs")
    links = verified(tested, "links-to-least")
    roots = components(links)

    def rooted(rows: DataFrame, t: str = "t", root: str = "root") -> DataFrame:
        return rows.join(roots.select(F.col("node").alias(t), F.col("root").alias(root)), t, "left").withColumn(root, F.coalesce(root, t))

    # Buckets that hold several classes: blocks of their texts meet, each two of them in one bounded group.
    def met(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = np.flatnonzero((pdf[["band", "key", "low", "high"]].diff() != 0).any(axis=1).to_numpy())
            held = pdf.iloc[new[-1] :] if len(pdf) else None  # the last group may go on in the next batch
            yield from (found for at, end in zip(new[:-1], new[1:], strict=True) if (found := pairs_of(pdf.iloc[at:end])) is not None)
        if held is not None and (found := pairs_of(held)) is not None:
            yield found
        give_back()

    def pairs_of(group: pd.DataFrame) -> pd.DataFrame | None:
        roots = group.groupby(["r1", "r2"], sort=False).ngroup().to_numpy()
        if roots.max() == 0:
            return None
        made = linked([np.frombuffer(x, np.uint64) for x in group["items"]], group["weight"].to_numpy(), roots, frequency.value, threshold)
        t = group[["t1", "t2"]].to_numpy()
        return pd.DataFrame([(*t[i], *t[j]) for i, j in made], columns=["a1", "a2", "b1", "b2"]) if made else None

    left = meetings(written(rooted(buckets.select("band", "key", "t")), "placed")).join(bodies, "t")
    left = left.select("band", "key", "low", "high", F.col("t.k1").alias("t1"), F.col("t.k2").alias("t2"), F.col("root.k1").alias("r1"), F.col("root.k2").alias("r2"), "weight", "items")
    group = ["band", "key", "low", "high"]
    more = left.repartition(*group).sortWithinPartitions(*group).mapInPandas(met, "a1 long, a2 long, b1 long, b2 long")
    more = written(more.select(_t("a1", "a2", "a"), _t("b1", "b2", "b")), "links-in-buckets")
    roots = components(links.unionByName(more))

    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # a root is a text of its class, too
    joined = texts.join(nodes.withColumnRenamed("node", "t"), "t").select("t", "root", "first", "n")
    named = written(joined.groupBy("root").agg(F.min(F.struct("first", "t")).alias("of"), F.sum("n").alias("size")), "classes")
    found = joined.join(named, "root").select("t", "of", "size")
    found = texts.select("t", F.struct("first", "t").alias("alone"), "n").join(found, "t", "left")
    of = F.coalesce("of", "alone")
    found = written(found.select(F.col("t.k1").alias("k1"), F.col("t.k2").alias("k2"), of["first"]["doc_id"].alias("class_id"), of["t"]["k1"].alias("c1"), of["t"]["k2"].alias("c2"), F.coalesce("size", "n").alias("class_size")), "classes-of-texts")
    return rows.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "k1", "k2", "class_id", "c1", "c2", "class_size")


def one_of_each(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of documents for each class: that of the least doc_id."""
    docs, key = keyed(documents)
    docs = docs.withColumn(own := unused(docs, "_own"), F.struct("doc_id"))  # a struct, so that a null doc_id equals itself
    keep = classes.filter("k1 = c1 and k2 = c2 and doc_id <=> class_id").select("k1", "k2", F.struct("doc_id")).distinct().toDF(*key, own)
    return docs.join(keep, [*key, own], "left_semi").dropDuplicates([*key, own]).select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")
