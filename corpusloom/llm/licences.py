"""License scan: canonical digests of entire texts, hash-joined to the digests of known licences.

The canonical form drops copyright lines, case, punctuation and white space and unifies equivalent spellings. A text is
entire if all of it, or all of one of its lines, is a known licence or notice: `license` names the one that the whole
document is, `notices` those that stand on lines of their own.

Lines are looked at only if they begin as a known text does; no text or line is shuffled, but for the few found ones.

Cases: null and empty texts (and texts of punctuation only) have an empty canonical form, which is no licence; repeated
rows are scanned one by one and alike; long texts are scanned whole; an empty table, or no known licences, gives no rows or no licences; known texts
with one digest go by the smallest of their names; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_key, written

#: The usual one-line notices. Whole licences are the public texts in licence_texts, by SPDX name; further
#: ones, of both kinds, come as a table known(license, text).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

#: The titles under which short licences stand, or none.
TITLES = {
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "BSL-1.0": ["", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "Zlib": ["", "zlib License", "The zlib License", "The zlib/libpng License"],
}


def _forms() -> list[tuple[str, str]]:
    """(license, text): whole licences, the short ones under each title, with numbered and with other lists; then notices."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        name, text = path.stem, path.read_text()
        if name in TITLES:
            body = text.split("\n", 1)[1]
            text = [f"{title}\n{b}" for title in TITLES[name] for b in dict.fromkeys([body, re.sub(r"(?m)^[0-9]\. ", "* ", body)])]
        out += [(name, t) for t in ([text] if isinstance(text, str) else text)]
        if name == "ISC":  # without its condition, it is another licence
            out += [("0BSD", t.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "").replace("ISC", "BSD Zero Clause")) for t in text]
    return out + NOTICES


KNOWN = _forms()

#: Fixed values: (pattern, replacement) in the order in which they apply to a lower-cased text; for Java and RE2 alike. The
#: first drops the lines of copyright, not those of a licence that merely begin with the word.
STEPS = [
    (r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]+(c\b|[0-9]{4}|year|yyyy|by\b)|c\)[^a-z0-9\n]+(copyright|[0-9]{4})|copyright[^a-z0-9\n]*©|all rights reserved)[^\n]*", r"\1"),
    (r"(^|\n)[ \t]*©[^\n]*", r"\1"),
    (r"[^a-z0-9]+", " "),
    (r"\b(sub|re)?(licence|licenses|licences)\b", r"\1license"),
    (r"\b(sub|re)?licenced\b", r"\1licensed"),
    (r"\b(author|organ|recogn|util|initial|optim|maxim|categor)is(e|ed|es|ing|ation|ations)\b", r"\1iz\2"),
    (r"\b(fav|lab|hon)our", r"\1or"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\b(non|sub) (commercial|infringement|licens)", r"\1\2"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\bcentre\b", "center"),
]
#: What a text holds if the first two steps, or any after the third, can change it.
_FIRST = ["copyright", "(c)", "©", "all rights reserved"]
_LATER = ["licenc", "licenses", "authoris", "organis", "recognis", "utilis", "initialis", "optimis", "maximis", "categoris", "favour", "labour", "honour"]
_LATER += ["acknowledgement", "non commercial", "non infringement", "sub licens", "copyright owner", "whilst", "per cent", "centre"]

#: No step changes so many of the first letters and digits of a line that it keeps.
_HEAD = 4


def _any(c: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])


def with_digest(rows: DataFrame, text: str, name: str = "digest", empty: str = "") -> DataFrame:
    """rows with the digest of the text's canonical form in place of the text; `empty` where that form is empty.

    The steps are columns of their own, so that each is worked out once and only where it can change the text. The digest
    is never null: a join would else filter on it, and the filter, pushed below, repeat the steps many times.
    """
    c = F.col(text)
    rows = rows.withColumn(text, F.lower(F.coalesce(c, F.lit(""))))
    for guard, steps in ((_FIRST, STEPS[:2]), (None, STEPS[2:3]), (_LATER, STEPS[3:])):
        done = c
        for pattern, put in steps:
            done = F.regexp_replace(done, pattern, put.replace("\\", "$"))
        rows = rows.withColumn(text, F.when(_any(c, guard), done).otherwise(c) if guard else done)
    rows = rows.withColumn(text, F.trim(c))
    return rows.withColumn(name, F.coalesce(F.when(c != "", F.sha2(c, 256)), F.lit(empty))).drop(*({text} - {name}))


def _head(c: Column) -> Column:
    """The first letters and digits."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(F.lower(c), rf"[a-z0-9](?:[^a-z0-9]*[a-z0-9]){{0,{_HEAD - 1}}}", 0), "[^a-z0-9]", ""), F.lit(""))


def _kept(c: Column) -> Column:
    """The lines that the first two steps keep."""
    for pattern, put in STEPS[:2]:
        c = F.regexp_replace(c, pattern, put.replace("\\", "$"))
    return c


def canonical(text: str) -> str:
    """The canonical form of one text: for the digests in the SQL, and for tests."""
    text = text.lower()
    for pattern, put in STEPS:
        text = re.sub(pattern, put, text, flags=re.ASCII)
    return text.strip(" ")


def known_licences(spark, rows=KNOWN) -> DataFrame:
    return spark.createDataFrame(list(rows), "license string, text string")


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Each row of documents(doc_id, text): doc_id, digest (of its canonical form), license (null if it isn't one) and notices (sorted)."""
    # Written, so that Spark knows their sizes, and broadcasts them where these are small.
    digests = written(with_digest(known.select("license", "text"), "text", empty="none").groupBy("digest").agg(F.min("license").alias("license")), "licence-digests")
    heads = written(known.select(_head(_kept(F.lower("text"))).alias("head")).distinct(), "licence-heads")
    lines = documents.select(*text_key(F.col("text")), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).withColumn("head", _head(F.col("line")))
    lines = with_digest(lines.join(heads, "head", "left_semi").select("k1", "k2", "line"), "line")
    notices = lines.join(digests, "digest").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    whole = with_digest(documents.select("doc_id", *text_key(F.col("text")), "text"), "text")
    found = whole.join(digests, "digest", "left").join(notices, ["k1", "k2"], "left")
    return found.select("doc_id", F.nullif("digest", F.lit("")).alias("digest"), "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licences(spark)).withColumn("notices", F.array_join("notices", ","))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def c(text: str) -> str:
        text = f"lower(coalesce({text}, ''))"
        for pattern, put in STEPS:
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')"
        return f"trim({text})"

    digests = sorted({(name, hashlib.sha256(canonical(text).encode()).hexdigest()) for name, text in KNOWN})
    known = ", ".join(f"({quoted(name)}, {quoted(digest)})" for name, digest in digests)
    return f"""
with k as (select min(license) as license, digest from (values {known}) v(license, digest) group by 2),
d as (select row_number() over () as r, doc_id, text, {c("text")} as canon from documents),
l as (select r, {c("line")} as canon from (select r, unnest(string_split(text, chr(10))) as line from d)),
n as (select r, string_agg(distinct license, ',' order by license) as notices from l join k on canon <> '' and sha256(canon) = digest group by r)
select doc_id, case when canon <> '' then sha256(canon) end as digest, license, coalesce(notices, '') as notices
from d left join n using (r) left join k on canon <> '' and sha256(canon) = digest
"""


SQL = _sql()
