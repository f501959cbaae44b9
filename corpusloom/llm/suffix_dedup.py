"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts at two places or more.

The suffixes are those of a parse. An anchor is the least of WINDOW consecutive hashes of GRAM bytes, so it depends on
nearby bytes only; the bytes between two anchors are one symbol. Each start of a string belongs to its first anchor beyond
the margin, and all strings of one anchor share the core, LENGTH // 3 bytes from the anchor on. A core is up to two whole
symbols and a tail.

1. Each shard (a batch of documents) has the transform of its own parse: the suffixes that begin with a tail, in order, and
   for each the symbols that stand before it, its last columns. Equal contexts of a shard settle each other; one entry
   stands for them from there on.
2. The shards' transforms meet by tail. A bucket's task merges them by refining their interleave: first it deals the runs
   out by tail, then each round is one LF step, which deals the interleave out, stably, by the next last column, so that the
   order is that of suffixes longer by one symbol. Where a block splits, the common prefix ends; blocks with one suffix are
   let go of. No suffix is compared with another, and nothing is sorted again but by one symbol. Blocks whose common prefix
   is a whole core are the repeated intervals.
3. An anchor whose strings all have a twin (its widest context repeats) is settled. For the others of a repeated interval,
   the hashes of their single strings are counted, dealt out by hash. A core with many contexts in one shard is known to
   repeat: its contexts pass by the buckets, so that a passage of many documents makes no large bucket.
4. Each document loses the bytes that its repeated strings cover.

Beside the bytes that go, texts are told that hold a passage of PASSAGE words which also stands in another text, or a
repeated string, whichever is shorter: a window of that many words belongs to the least hash of its first WINDOW places, and
is counted in the same way.

Cases: a null text is an empty one; texts under LENGTH bytes stay whole; equal texts repeat each other whatever their
doc_id; of equal hashes the leftmost is the anchor; runs of one byte and long texts take linear time; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table, text_key, written
from .text_arrays import CHUNK, WORD_BYTES, lowered, mix, powers
from .text_arrays import runs as runs_of

#: Bytes of a repeated string; bytes of a hash; hashes of a window. LENGTH must be 4 * WINDOW + GRAM - 1 at least.
LENGTH, GRAM, WINDOW = 400, 16, 96

#: Words of a passage that is told of when it stands in two texts.
PASSAGE = 50

#: Bytes of text for each bucket of step 2; contexts of a core in one shard beyond which they pass by the buckets.
BUCKET, MANY = 1 << 24, 8

#: A suffix: its tail and what stands before it, the hash of its widest context, how many there are, and where one is.
_ENTRY = np.dtype([("tail", "<u8"), ("s2", "<u4"), ("s1", "<u4"), ("wide", "<u8"), ("many", "<u4"), ("doc", "<u4"), ("anchor", "<i4"), ("first", "<i4"), ("last", "<i4")])

#: The last columns, from the tail on.
_BEFORE = ("s2", "s1")

#: As `many`: stands for a core whose contexts pass by the buckets.
_PASSED = 0xFFFFFFFF

#: A string of a text, or a passage (which has no start, and none that touches a string's).
_STRING = np.dtype([("doc", "<u4"), ("start", "<i4"), ("name", "<u8")])
_TOLD = -9


class Prefix:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def least_places(prefix: Prefix, n: int, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """For each place, the place of the least hash of the window that begins there, the leftmost of equal ones."""
    grams = n - gram + 1
    if grams < window:
        return np.zeros(0, np.int64)
    place = np.arange(grams)
    bits = np.uint64(32)
    h = prefix.of(place, place + gram) >> bits << bits | place.astype(np.uint64)
    full = np.full(-(-grams // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:grams] = h
    rows = full.reshape(-1, window)  # least of a window: of the end of one row and the beginning of the next
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: grams - window + 1], ahead[window - 1 : grams])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(prefix: Prefix, n: int, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    least = least_places(prefix, n, gram, window)
    return np.unique(least[np.append(True, least[1:] != least[:-1])]) if len(least) else least


def _groups(texts: list[bytes]):
    """Whole texts of about CHUNK bytes together, as (number of the first, joined bytes, begins)."""
    group, size, first = [], 0, 0
    for i, b in enumerate([*texts, None]):
        if group and (b is None or size + len(b) > CHUNK):
            yield first, np.frombuffer(b"".join(group), np.uint8), np.append(0, np.cumsum([len(g) for g in group]))
            group, size, first = [], 0, i
        if b is not None:
            group.append(b)
            size += len(b)


def suffixes(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """A shard's suffixes, in order: the entries of all anchors of texts with a whole core. Those to which no strings belong have last < first."""
    made = []
    margin, core, reach = window - 1, length // 3, length - gram - 3 * window + 3  # anchors up to `reach` behind an anchor are in all its strings
    for number, data, begins in _groups(texts):
        prefix = Prefix(data)
        at = anchors(prefix, len(data), gram, window)
        if not len(at):
            continue
        before = np.append(at[0] - window, at[:-1])
        doc = np.searchsorted(begins, at, "right") - 1
        low = np.maximum(begins[doc], before - margin + 1)
        high = np.minimum(at - margin, begins[doc + 1] - length)
        use = np.flatnonzero(at + core <= begins[doc + 1])
        a, lo, hi, d = at[use], low[use], np.maximum(high[use], low[use] - 1), doc[use]
        after = [np.append(at, [1 << 40] * 2)[use + k] for k in (1, 2)]
        stop = [np.minimum(x, a + core) for x in after]
        entry = np.zeros(len(use), _ENTRY)
        inside = [x <= a + reach for x in after]  # is the symbol a whole one?
        entry["s1"] = np.where(inside[0], prefix.of(a, stop[0]) >> np.uint64(32), 0)
        entry["s2"] = np.where(inside[1], prefix.of(stop[0], stop[1]) >> np.uint64(32), 0)
        entry["tail"] = prefix.of(np.where(inside[1], stop[1], np.where(inside[0], stop[0], a)), a + core)
        text = prefix.of(begins[d], begins[d + 1])
        strings = hi >= lo
        end = np.where(strings, hi + length, lo)
        entry["wide"] = mix(np.where(strings, prefix.of(lo, end), text) + mix(np.where(strings, (a - lo) * 4096 + (hi - lo), a - begins[d] + (1 << 40)).astype(np.uint64)))
        entry["many"], entry["doc"] = 1, d + number
        for name, x in (("anchor", a), ("first", lo), ("last", hi)):
            entry[name] = x - begins[d]
        made.append(entry)
    entry = np.concatenate(made) if made else np.zeros(0, _ENTRY)
    return entry[np.lexsort((entry["wide"], entry["s1"], entry["s2"], entry["tail"]))]


def _changes(entry: np.ndarray, *names: str) -> np.ndarray:
    """Where one of the fields is another than before."""
    new = np.ones(len(entry), bool)
    if len(entry):
        new[1:] = np.logical_or.reduce([entry[n][1:] != entry[n][:-1] for n in names])
    return new


def local_twins(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's sorted entries -> (one entry for each context, with their number; the entries that have a twin in the shard;
    the contexts of cores with more than MANY of them, which leave one entry behind)."""
    new = _changes(entry, "tail", "s2", "s1", "wide")
    heads = np.flatnonzero(new)
    many = np.diff(np.append(heads, len(entry)))
    twins = entry[(many > 1)[np.cumsum(new) - 1]]
    entry = entry[heads]
    entry["many"] = many
    new = _changes(entry, "tail", "s2", "s1")
    first = np.flatnonzero(new)
    crowd = np.diff(np.append(first, len(entry))) > MANY
    passed = crowd[np.cumsum(new) - 1] if len(entry) else np.zeros(0, bool)
    by = entry[passed]
    entry["many"][first[crowd]] = _PASSED
    return entry[~passed | np.isin(np.arange(len(entry)), first[crowd])], twins, by


def joined_runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, sorted by document; those that touch or overlap are one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order].astype(np.int64), first[order].astype(np.int64), last[order].astype(np.int64)
    if not len(doc):
        return doc, first, last
    reach = np.maximum.accumulate(last + (doc << 32))  # a later document's places count as greater
    new = np.append(True, (first[1:] + (doc[1:] << 32) > reach[:-1] + 1) | (doc[1:] != doc[:-1]))
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(doc)) - 1
    return doc[heads], first[heads], reach[ends] - (doc[heads] << 32)


def interleaved(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The transforms of shards -> (order of the suffixes of all repeated intervals, interval of each).

    order counts through the concatenated runs: which run comes next is the interleave. Blocks of one suffix are let go of
    as soon as they arise, so what is left after the last round has a common prefix of all symbols.
    """
    many = np.concatenate([np.minimum(r["many"], 2) for r in runs]).astype(np.int64)
    columns = [np.concatenate([r[name] for r in runs]) for name in ("tail", *_BEFORE)]
    z, block = np.arange(len(many)), np.zeros(len(many), np.int64)
    for column in columns:
        step = np.argsort(column[z], kind="stable")  # the LF step: dealt out by one symbol, else in the order there was
        z, block = z[step], block[step]
        new = np.ones(len(z), bool)
        new[1:] = (column[z[1:]] != column[z[:-1]]) | (block[1:] != block[:-1])
        block = np.cumsum(new) - 1
        live = (np.add.reduceat(many[z], np.flatnonzero(new)) > 1)[block] if len(z) else new
        z, block = z[live], block[live]
    return z, block


_REFS = "k1 long, k2 long, settled boolean, anchor int, first int, last int"


def _refs(key: np.ndarray, entry: np.ndarray, settled) -> pd.DataFrame:
    return pd.DataFrame({"k1": key[entry["doc"], 0], "k2": key[entry["doc"], 1], "settled": settled} | {n: entry[n] for n in ("anchor", "first", "last")})


def repeats(documents: DataFrame, length: int = LENGTH, bucket: int = BUCKET, passage: int = PASSAGE) -> tuple[DataFrame, DataFrame]:
    """documents(text) -> (k1, k2, first, last: runs of starts of strings of `length` bytes that also start elsewhere, or _TOLD for
    a passage that also stands in another text; k1, k2, text: the texts with any of these, and more)."""
    texts = documents.select(*text_key(F.col("text")), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= length // 3 + WINDOW)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // bucket) + 1

    def shards(batches):
        for number, pdf in enumerate(batches):
            keys = pdf[["k1", "k2"]].to_numpy().astype("<i8")
            entry, twins, by = local_twins(suffixes(pdf["text"].tolist(), length))
            to = (entry["tail"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1)) if buckets < 4096 else np.append(np.flatnonzero(np.append(True, np.diff(to[order]) != 0)[: len(to)]), len(to))
            parts = [(int(to[part[0]]), "merge", entry[part]) for part in np.split(order, cut[1:-1]) if len(part)]
            # What the shard knows by itself passes by the buckets.
            aside = buckets + (TaskContext.get().partitionId() * 7919 + number) % buckets
            parts += [(aside, kind, x) for kind, x in (("settled", twins[twins["last"] >= twins["first"]]), ("asked", by)) if len(x)]
            rows = []
            for b, kind, part in parts:
                part = part.copy()
                docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
                rows.append((b, kind, part.tobytes(), keys[docs].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "run", "docs"])
        give_back()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, keys, base = [], [], 0
        for r, d in zip(pdf["run"], pdf["docs"], strict=True):
            run = np.frombuffer(r, _ENTRY).copy()
            run["doc"] += base
            base += len(d) // 16
            runs.append(run)
            keys.append(np.frombuffer(d, "<i8").reshape(-1, 2))
        key = np.concatenate(keys)
        if pdf["kind"].iloc[0] != "merge":
            return pd.concat([_refs(key, run, kind == "settled") for run, kind in zip(runs, pdf["kind"], strict=True)])
        z, block = interleaved(runs)
        entry = np.concatenate(runs)[z]
        # Widest contexts inside each interval.
        order = np.lexsort((entry["wide"], block))
        entry, block = entry[order], block[order]
        new = np.ones(len(entry), bool)
        new[1:] = (block[1:] != block[:-1]) | (entry["wide"][1:] != entry["wide"][:-1])
        context, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        twin = np.add.reduceat(np.minimum(entry["many"], 2).astype(np.int64), heads) > 1 if len(heads) else np.zeros(0, bool)
        lonely = np.zeros(block.max() + 1 if len(block) else 0, bool)  # intervals with a context that has no twin, or that passed by
        lonely[block[heads[~twin]]] = True
        lonely[block[entry["many"] == _PASSED]] = True
        done = np.flatnonzero(twin[context] & (entry["many"] == 1) & (entry["last"] >= entry["first"]))  # the others were settled in their shard
        take = np.concatenate([done, heads[lonely[block[heads]]]])
        return _refs(key, entry[take], np.arange(len(take)) < len(done))

    found = texts.mapInPandas(shards, "bucket int, kind string, run binary, docs binary")
    refs = written(found.groupBy("bucket").applyInPandas(settle, _REFS), "intervals")
    marks = refs.groupBy("k1", "k2").agg(F.collect_set(F.struct("settled", "anchor", "first", "last")).alias("marks"))
    bodies = written(texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(marks, ["k1", "k2"]), "marked-texts")

    def strings(batches):
        for pdf in batches:
            made = []
            for i, (text, marks) in enumerate(zip(pdf["text"], pdf["marks"], strict=True)):
                settled, anchor, first, last = (np.array([m[n] for m in marks]) for n in ("settled", "anchor", "first", "last"))
                if settled.all():
                    continue
                data = np.frombuffer(text, np.uint8)
                prefix = Prefix(data)
                n = np.where(settled, 0, last - first + 1)
                start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                name = prefix.of(start, start + length)
                if not settled.any():
                    at = passages(data, prefix, anchor, length // 3, passage)
                    start, name = np.append(start, np.full(len(at), _TOLD)), np.append(name, at)
                one = np.zeros(len(start), _STRING)
                one["doc"], one["start"], one["name"] = i, start, name
                made.append(one)
            every = np.concatenate(made) if made else np.zeros(0, _STRING)
            to = (every["name"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            every, to = every[order], to[order]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
            keys, rows = pdf[["k1", "k2"]].to_numpy().astype("<i8"), []
            for part in np.split(every, cut[1:]) if len(every) else ():
                b = int(part["name"][0] % np.uint64(buckets))
                docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
                rows.append((b, part.tobytes(), keys[docs].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "run", "docs"])
        give_back()

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, keys, base = [], [], 0
        for r, d in zip(pdf["run"], pdf["docs"], strict=True):
            part = np.frombuffer(r, _STRING).copy()
            part["doc"] += base
            base += len(d) // 16
            parts.append(part)
            keys.append(np.frombuffer(d, "<i8").reshape(-1, 2))
        every, key = np.concatenate(parts), np.concatenate(keys)
        _, same, many = np.unique(every["name"], return_inverse=True, return_counts=True)
        every = every[many[same] > 1]
        doc, first, last = joined_runs(every["doc"], every["start"], every["start"])
        return pd.DataFrame({"k1": key[doc, 0], "k2": key[doc, 1], "first": first, "last": last})

    single = bodies.select("k1", "k2", "text", "marks").mapInPandas(strings, "bucket int, run binary, docs binary").groupBy("bucket").applyInPandas(counted, "k1 long, k2 long, first int, last int")
    settled = bodies.select("k1", "k2", F.explode("marks").alias("m")).filter("m.settled").select("k1", "k2", "m.first", "m.last")
    return settled.unionByName(single), bodies.select("k1", "k2", "text")


def passages(data: np.ndarray, prefix: Prefix, anchor: np.ndarray, core: int, words: int) -> np.ndarray:
    """The hashes, each once, of all runs of so many words that belong to one of these anchors and hold its core."""
    starts, ends = runs_of(WORD_BYTES[lowered(data)])
    least = least_places(prefix, len(data))
    n = min(len(starts) - words + 1, int(np.searchsorted(starts, len(least))))
    if n <= 0:
        return np.zeros(0, np.uint64)
    start, end = starts[:n], ends[words - 1 : words - 1 + n]
    use = np.isin(least[start], anchor) & (end >= least[start] + core)
    return np.unique(mix(prefix.of(start[use], end[use]) ^ np.uint64(0x9A55A6E)))


CUT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def cut(text: bytes, runs: list, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of text without the bytes that strings with these starts cover, and the maximal spans removed."""
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]]), [(s, e) for s, e in spans]


def shortened_texts(documents: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """k1, k2, kept (bytes), and spans (removed: start, end)
    of the texts of documents(text) that lose bytes or hold a passage of another text."""

    def cut_all(batches):
        for pdf in batches:
            made = [cut(t, [(r["first"], r["last"]) for r in rs if r["first"] >= 0], length) for t, rs in zip(pdf["text"], pdf["runs"], strict=True)]
            yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "kept": [m[0] for m in made], "spans": [[{"start": s, "end": e} for s, e in m[1]] for m in made]})
        give_back()

    found, bodies = repeats(documents.select("text"), length, passage=passage)
    found = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    shape = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *CUT.fields])
    return bodies.join(found, ["k1", "k2"]).mapInPandas(cut_all, shape)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each row of documents(doc_id, text): doc_id, n_bytes, kept (bytes), spans (removed: start, end) and shared (does it lose
    bytes, or hold a passage that stands in another text, too?)."""
    found = written(shortened_texts(documents, length), "shortened")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *text_key(F.col("text"))).join(found, ["k1", "k2"], "left")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("kept", "text").alias("kept"), F.coalesce("spans", F.array().cast(CUT["spans"].dataType)).alias("spans"), F.col("kept").isNotNull().alias("shared"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The digests of texts that stay whole need no text beside those that don't, so only digests are joined.
    found = shortened_texts(documents).select("k1", "k2", F.octet_length("kept").alias("n_kept"), F.size("spans").alias("spans"), F.sha2("kept", 256).alias("sha"))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", *text_key(F.col("text")), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole_sha"))
    return rows.join(written(found, "shortened"), ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.col("n_bytes") - F.col("n_kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole_sha").alias("kept_sha256"),
        F.when(F.col("n_kept").isNotNull(), 1).otherwise(0).cast("long").alias("n_shared"),
    )
