"""URL filter: host and path rules first, then a blocked Bloom filter in front of an exact hash join.

Only DataFrame expressions are used. Cases: a null URL, or one without "://", has an empty host and path, fits no rule
and is allowed; an empty table or an empty list gives an empty result or a filter that holds nothing; repeated rows are
judged one by one and alike; URLs are read whole, however long. Other columns of the input pass through unread, but a column
that has the name of one of the result's (host, path, canonical, rule, verdict, listed) or is called block is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: (verdict, host, path prefix). Rules are configuration: a bounded list, not a table that grows.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Bits of filter for each listed URL and bits set for each: about 1 in 1,000 URLs that aren't listed pass.
BITS_PER_KEY, PROBES, BLOCK_BITS = 16, 6, 256

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without "www.", path without a closing slash, query without utm_ fields; scheme and fragment go. Null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, _PARTS, 3), r"([?&])utm_[^&]*", "$1")
    query = F.regexp_replace(F.regexp_replace(query, r"&{2,}", "&"), r"^\?&|[?&]+$", "")
    query = F.regexp_replace(query, r"^\??", "?")
    return F.when(host != "", F.concat(host, path, F.when(query == "?", "").otherwise(query)))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    made = [F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (v, h, p) in zip(fits, ordered, strict=True)]
    return F.coalesce(*made) if made else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _masks(key: Column) -> list[Column]:
    """The bits of a key inside its block, as BLOCK_BITS / 64 longs."""
    h = F.xxhash64(F.lit(1), key)
    places = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    masks = []
    for w in range(BLOCK_BITS // 64):
        bits = [F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for p in places]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"m{w}"))
    return masks


def bloom_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """listed(canonical), distinct -> the filter's blocks that hold anything, one row each, and how many blocks there are.

    The filter has BITS_PER_KEY bits for each listed URL. It is a table: Spark broadcasts it while it is under
    spark.sql.autoBroadcastJoinThreshold and joins it by block number beyond that.
    """
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // BLOCK_BITS))
    rows = listed.select(_block(F.col("canonical"), blocks), *_masks(F.col("canonical")))
    return rows.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"f{w}") for w in range(BLOCK_BITS // 64)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, canonical, rule, verdict and listed added.

    A page's verdict is its longest rule's; without a rule it is block for a canonical URL in listed(canonical), else allow.
    """
    listed = written(listed.select("canonical").filter("canonical is not null").distinct(), "listed")  # read three times
    blocks, n = bloom_blocks(listed)
    clash = [c for c in ("host", "path", "canonical", "rule", "verdict", "listed", "block") if c in pages.columns]
    pages = pages.drop(*clash)
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "canonical": canonical_url(F.col(url))}).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    out = [*pages.columns, "host", "path", "canonical"]
    ruled = parts.filter("fit is not null").select(*out, "fit.rule", "fit.verdict", F.lit(False).alias("listed"))
    # Pages without a canonical URL are on no list; they would all have one block.
    nameless = parts.filter("fit is null and canonical is null").select(*out, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    free = parts.filter("fit is null and canonical is not null").withColumn("block", _block(F.col("canonical"), n))
    tested = free.join(blocks, "block", "left")
    passes = reduce(lambda a, b: a & b, [F.col(f"f{w}").bitwiseAND(m) == m for w, m in enumerate(_masks(F.col("canonical")))])
    tested = tested.withColumn("possible", F.coalesce(passes, F.lit(False)))
    rule = F.lit(None).cast("string").alias("rule")
    clear = tested.filter(~F.col("possible")).select(*out, rule, F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    exact = tested.filter("possible").join(listed.withColumn("hit", F.lit(True)), "canonical", "left")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    exact = exact.select(*out, rule, F.when(hit, "block").otherwise("allow").alias("verdict"), hit.alias("listed"))
    return ruled.unionByName(nameless).unionByName(clear).unionByName(exact)


def mirrored_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The canonical URLs under which two or more pages were fetched: the list for the query over pages."""
    return pages.select(canonical_url(F.col(url)).alias("canonical")).filter("canonical is not null").groupBy("canonical").count().filter("count > 1").select("canonical")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, mirrored_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with p as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') as path,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') as q0
  from pages
), q as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(q0, '([?&])utm_[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '^\?&|[?&]+$', '', 'g'), '^\??', '?') as q1
  from p
), c as (
  select *, case when regexp_replace(host, '^www\.', '') <> '' then regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || case when q1 = '?' then '' else q1 end end as canonical
  from q
), r as (
  select *,
    case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from c
), l as (select canonical from c where canonical is not null group by canonical having count(*) > 1)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when canonical in (select canonical from l) then 'block' else 'allow' end as verdict
from r
"""
