"""Benchmark decontamination: a prefix-filtered join of the benchmark's windows against every word of the corpus.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. Windows and
documents are taken as sets of shingles (SHINGLE consecutive words, or all words of a shorter window). A document that
contains a window contains all its shingles, so the necessary prefix of a window is one shingle: the one that is rarest
in the corpus (of equally rare ones that of the smallest hash). A first pass counts the windows' shingles in the corpus; a
second one joins the prefixes only. Their hits, with their positions, give the only places where a window can stand;
places that don't fit into the document are dropped (length and position bounds) and the rest is compared word by word,
beside the document's words: no text is shuffled. Only with more than BROADCAST windows are texts shuffled, once.

Only DataFrame expressions are used. Cases: null texts have no words; rows with a null item_id or text are no items;
very long texts are taken whole; an empty benchmark or corpus gives clean documents or no rows; equal texts get equal results, whatever their doc_id, and
each row of the input has its row in the result; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, table, text_key, words, written

WINDOW, SHINGLE = 10, 3

#: So many windows at most (some 200 bytes each) are sent to all tasks; beyond that shingles with their places meet them by a
#: shuffled join, and each text that has a place where a window may stand meets its places once.
BROADCAST = 200_000


def _shingles(ws: Column, sizes: list[int]) -> Column:
    """(hash, at) of all runs of each size in ws."""

    def of(n: int) -> Column:
        last = F.size(ws) - n
        runs = F.transform(F.slice(ws, 1, F.greatest(last + 1, F.lit(0))), lambda w, i: F.struct(F.xxhash64(F.lit(n), w, *[F.get(ws, i + j) for j in range(1, n)]).alias("shingle"), i.alias("at")))
        return runs

    return F.concat(*[of(n) for n in sizes])


def _places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """docs(k1, k2, dws) -> k1, k2, dws, shingle, at: all runs of each size in dws. Rows of words are hashed by generated code, other than arrays."""
    n = max(sizes)
    grams = F.arrays_zip(*[F.slice("dws", k + 1, F.size("dws")) for k in range(n)])
    rows = docs.select("k1", "k2", "dws", F.posexplode(grams).alias("at", "g"))
    ws = [F.col("g")[str(k)] for k in range(n)]
    made = [F.when(ws[m - 1].isNotNull(), F.xxhash64(F.lit(m), *ws[:m])) for m in sizes]
    rows = rows.select("k1", "k2", "dws", "at", (made[0] if len(made) == 1 else F.explode(F.array(*made))).alias("shingle"))
    return rows.filter("shingle is not null")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """benchmark(item_id, text) -> each different window: its words ws and the items (as strings) that hold it."""
    ws = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    runs = ws.select("item", F.explode(F.transform(starts, lambda s: F.slice("ws", s, window))).alias("ws"))
    return runs.groupBy("ws").agg(F.collect_set("item").alias("items"))


def find_items(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, keep_key: bool = False) -> DataFrame:
    """Each row of documents(doc_id, text): doc_id, n_words, n_hit, items (sorted) and hits (start and length, in words, of each window found).

    keep_key adds k1 and k2, which stand for the text."""
    windows = written(item_windows(benchmark, window), "windows")
    size = F.least(F.size("ws"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect()) or [shingle]  # at most SHINGLE numbers
    of_size = F.coalesce(*[F.when(size == n, _shingles(F.col("ws"), [n])) for n in sizes])
    parts = written(windows.select("ws", "items", F.explode(of_size).alias("s")).select("ws", "items", "s.*"), "window-shingles")
    sent = windows.count() <= BROADCAST
    small = (lambda df: F.broadcast(df)) if sent else (lambda df: df)

    # How often each shingle of a window stands in the corpus: added up in each task before anything is shuffled.
    docs = documents.select(*text_key(F.col("text")), words(F.col("text")).alias("dws"))
    places = _places(docs, sizes)
    rarity = places.select("shingle").join(small(parts.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))

    # The rarest shingle of each window that the corpus may hold is its necessary prefix; only prefixes meet the corpus.
    ranked = parts.join(written(rarity, "rarity"), "shingle", "left").groupBy("ws", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("p"))
    prefix = written(ranked.filter("p.n > 0").select("ws", "items", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("off")), "prefixes")
    start = F.col("at") - F.col("off")

    def stands(at: Column, ws: Column) -> Column:
        return (at >= 0) & (at + F.size(ws) <= F.size("dws")) & (F.slice("dws", F.greatest(at, F.lit(0)) + 1, F.size(ws)) == ws)

    if sent:
        spots = places.join(F.broadcast(prefix), "shingle").filter(stands(start, F.col("ws"))).select("k1", "k2", F.struct(start.alias("start"), F.size("ws").alias("length"), "items").alias("spot"))
        found = spots.groupBy("k1", "k2").agg(F.collect_set("spot").alias("found"))  # copies of a text share theirs
    else:
        maybe = places.select("k1", "k2", "at", "shingle").join(prefix, "shingle").filter(start >= 0)
        maybe = written(maybe.groupBy("k1", "k2").agg(F.collect_set(F.struct(start.alias("start"), "ws", "items")).alias("maybe")), "maybe")
        held = documents.select(*text_key(F.col("text")), "text").join(maybe, ["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("dws"), "maybe")
        spots = F.transform(F.filter("maybe", lambda m: stands(m["start"], m["ws"])), lambda m: F.struct(m["start"].alias("start"), F.size(m["ws"]).alias("length"), m["items"].alias("items")))
        found = held.select("k1", "k2", spots.alias("found")).filter(F.size("found") > 0).groupBy("k1", "k2").agg(F.first("found").alias("found"))
    found = written(found, "places")

    key = ["k1", "k2"] if keep_key else []
    docs = documents.select("doc_id", *text_key(F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words")).join(found, ["k1", "k2"], "left")
    covered = F.array_distinct(F.flatten(F.transform("found", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    none = F.array()
    return docs.select(
        "doc_id",
        *key,
        "n_words",
        F.when(F.col("found").isNotNull(), F.size(covered)).otherwise(0).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda s: s["items"])))), none.cast("array<string>")).alias("items"),
        F.coalesce(F.transform("found", lambda s: F.struct(s["start"], s["length"])), none.cast("array<struct<start:int,length:int>>")).alias("hits"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no window of the benchmark; all columns stay."""
    # A table of its own: a filter on n_hit would else be pushed below, and the words be worked out anew for each place.
    found = written(find_items(documents.select("doc_id", "text"), benchmark, keep_key=True).select("k1", "k2", "n_hit"), "contaminated")
    docs, key = keyed(documents)
    bad = found.filter("n_hit > 0").select("k1", "k2").distinct().toDF(*key)
    return docs.join(bad, key, "left_anti").select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents
), i as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where item_id is not null and text is not null
), w as (
  select distinct item, least(len(ws), 10) as n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') as win
  from (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as s from i where len(ws) > 0)
), p as (
  select r, n, s, array_to_string(ws[s:s + n - 1], ' ') as win
  from (select r, n, ws, unnest(range(1, len(ws) - n + 2)) as s from d, (select distinct n from w) where len(ws) >= n)
), h as (select r, p.n, s, item from p join w on p.n = w.n and p.win = w.win)
, c as (select r, count(distinct pos) as n_hit from (select r, unnest(range(s, s + n)) as pos from h) group by r)
, t as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join t using (r)
"""
