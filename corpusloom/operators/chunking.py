"""Sections to overlapping chunks of bounded words.

Splitting is done by expressions. Packing depends on what has been packed before, over long texts; as a fold of
expressions it evaluates its nested parts again and again, so one small function in a pandas UDF does it, a section at a
time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MAX_OVERLAP_SENTENCE, MAX_WORDS, MIN_WORDS, OVERLAP_WORDS, WINDOW_WORDS, WS
from ..functions.text import fix_mojibake, on_one_line, strip, uuid5, word_run

#: Sections whose chunks a task holds at once.
AT_ONCE = 256

#: Where a sentence ends, before a capital or a digit; and where it may end else.
_STRONG_END, _ANY_END = r"(?<=[.!?]){}+(?=[\"'(\[]?[A-Z0-9])", r"(?<=[.!?]){}+"


def split_paragraphs(normal: Column) -> Column:
    """The paragraphs of a text with normalised white space."""
    return F.filter(F.transform(F.split(normal, rf"\n{WS}*\n"), strip), lambda p: p != "")


def split_sentences(normal: Column) -> Column:
    """The sentences of a text with normalised white space: at strong ends; where it has none, at every full stop, ! and ?."""
    strong = F.split(normal, _STRONG_END.format(WS))
    return F.filter(F.transform(F.when(normal.rlike(_STRONG_END.format(WS)), strong).otherwise(F.split(normal, _ANY_END.format(WS))), strip), lambda p: p != "")


def word_windows(text: str) -> Column:
    """Runs of WINDOW_WORDS words of a column, each matched as one, so that a text is gone through once."""
    return F.transform(F.regexp_extract_all(fix_mojibake(F.col(text)), F.lit(word_run(WINDOW_WORDS)), F.lit(0)), on_one_line)


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\xa0", " "))).strip()


def _sentences(text: str) -> list[str]:
    parts = re.split(_STRONG_END.format(r"\s"), text)
    return [p for x in (parts if len(parts) > 1 else re.split(_ANY_END.format(r"\s"), text)) if (p := x.strip())]


def _windows(text: str) -> list[str]:
    w = text.split()
    return [" ".join(w[i : i + WINDOW_WORDS]) for i in range(0, len(w), WINDOW_WORDS)]


def _packed(items: list[str], joint: str, split) -> list[str]:
    """Chunks of whole items. One that would overfill a chunk starts the next, unless the chunk would then miss the minimum by more than it would else pass the maximum; items over the maximum are split."""
    groups: list[list[str]] = [[]]
    held = 0
    for item in items:
        n = len(item.split())
        over, short = held + n - MAX_WORDS, MIN_WORDS - held
        if n > MAX_WORDS:
            groups += [[part] for part in split(item)] + [[]]
            held = 0
        elif groups[-1] and over > 0 and (short <= 0 or short <= over):
            groups.append([item])
            held = n
        else:
            groups[-1].append(item)
            held += n
    return [joint.join(g) for g in groups if g]


def base_chunks(text: str | None) -> list[str]:
    """A section's chunks before overlap."""
    tidy = _tidy(text or "")
    if len((text or "").split()) <= MAX_WORDS:
        return [tidy] if tidy else []
    paragraphs = [p for x in re.split(r"\n\s*\n", tidy) if (p := x.strip())]
    return _packed(paragraphs, "\n\n", lambda p: _packed(_sentences(p), " ", _windows))


def tail(chunk: str) -> str:
    """What the next chunk repeats: the last sentence, or its last words if it is long."""
    last = (_sentences(chunk) or [chunk])[-1]
    w = last.split()
    return last if len(w) <= MAX_OVERLAP_SENTENCE else " ".join(w[-OVERLAP_WORDS:])


def overlapping_chunks(text: str | None) -> list[str]:
    base = base_chunks(text)
    before = ["", *map(tail, base)]
    return [x if not t or x.startswith(t) else f"{t}\n\n{x}" for t, x in zip(before, base, strict=False)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunks_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for i in range(0, len(texts), AT_ONCE):
            yield pd.Series([overlapping_chunks(t) for t in texts.iloc[i : i + AT_ONCE]], dtype=object)


#: Told to be non-deterministic, since a filter on its size, which an explode brings, would else pack each text once more.
chunks_of = _chunks_of.asNondeterministic()


def chunk_sections(sections: DataFrame, key: list[str], text: str = "section_text") -> DataFrame:
    """sections -> one row for each chunk: the section's other columns, chunk_index (from 0), chunk_text, chunk_id.

    chunk_id is the name-based UUID of key and index, so that a retried task gives the same one.
    """
    repaired = sections.withColumn("_parts", chunks_of(fix_mojibake(F.col(text))))  # the packer tidies white space itself
    rows = repaired.select(*[c for c in sections.columns if c != text], F.posexplode("_parts").alias("chunk_index", "chunk_text"))
    return rows.withColumn("chunk_id", uuid5(F.concat_ws("/", *[F.col(k).cast("string") for k in key], F.col("chunk_index").cast("string"))))
