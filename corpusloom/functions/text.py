"""Text functions: Column in, Column out. Null in, null out unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ENTRY_NAMESPACE, NOT_WS, RERANK_OUTLINE_LINES, RERANK_OVERVIEW_WORDS, STOPWORDS, WS


#: NOT_WS for Java, with the common characters first; the white space that doesn't belong to a text's words is never tried again (++, *+).
_W = rf"[!-~\xa1-\x{{167f}}{NOT_WS}]"


def word_run(n: int) -> str:
    """A pattern: the longest run of at most n words, of those that are left."""
    return rf"{_W}++(?:{WS}++{_W}++){{0,{n - 1}}}+"


def on_one_line(run: Column) -> Column:
    return F.regexp_replace(run, f"{WS}++", " ")


def first_words(c: Column, n: int) -> Column:
    """The first n words (1 at least), on one line: nothing after them is looked at."""
    return on_one_line(F.regexp_extract(c, f"^{WS}*+({word_run(n)})", 1))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_extract(c, f"(?s)^{WS}*+(.*{_W})", 1)


def maybe_mojibake(c: Column) -> Column:
    """Whether a text, or one of those joined in it, may be changed by fix_mojibake."""
    return c.rlike(r"[\x{c3}\x{c2}\x{e2}\x{80}-\x{9f}]")


def fix_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 (up to twice) set right; the whole text or nothing.

    Nearly all texts fail the first test and are returned as they are; only the others are worked on, as an array's element,
    so that what c stands for isn't worked out again for each mention.
    """

    def garbled(x: Column) -> Column:
        return maybe_mojibake(x) & ~x.rlike(r"[^\x{00}-\x{ff}]")

    def once(x: Column) -> Column:
        # encode() raises on what Latin-1 lacks, so only what passed the test reaches it
        return F.coalesce(F.when(garbled(x), F.try_validate_utf8(F.encode(F.when(garbled(x), x), "ISO-8859-1").cast("string"))), x)

    return F.when(garbled(c), F.get(F.transform(F.transform(F.array(c), once), once), F.lit(0))).otherwise(c)


def repair_strings(c: Column) -> Column:
    """fix_mojibake for all elements of an array."""
    return F.transform(c, fix_mojibake)


def repair_values(c: Column) -> Column:
    """fix_mojibake for all values of a map; keys stay."""
    return F.transform_values(c, lambda _, v: fix_mojibake(v))


def normalize_whitespace(c: Column) -> Column:
    """Repaired, with single spaces and at most one empty line between paragraphs."""
    c = F.regexp_replace(fix_mojibake(c), "\xa0", " ")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(c)


def clean_text(c: Column) -> Column:
    """Repaired, on one line."""
    return strip(F.regexp_replace(fix_mojibake(c), f"{WS}+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{_W}++"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def truncate_words(c: Column, n: int) -> Column:
    """The text as it is if it has at most n words, else its first n words on one line."""
    return F.when(c.rlike(f"^{WS}*+(?:{_W}++{WS}++){{{n}}}+{_W}"), first_words(c, n)).otherwise(strip(c))


def trim_to_words(c: Column, n: Column | int) -> Column:
    """The first n words of the normalised text, on one line."""
    c = fix_mojibake(c)  # white space of any kind parts words alike
    return first_words(c, n) if not isinstance(n, Column) and n > 0 else F.array_join(F.slice(words(c), F.lit(1), n if isinstance(n, Column) else F.lit(n)), " ")


def trailing_words(c: Column, n: int) -> Column:
    w = words(normalize_whitespace(c))
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)), " ")


def normalize_lexical(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "’", "'"), r"'s(?![\p{L}\p{N}_])", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def lexical_tokens(c: Column, drop_stopwords: bool = False) -> Column:
    tokens = F.filter(F.split(normalize_lexical(c), " "), lambda t: t != "")
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS)) if drop_stopwords else tokens


def strip_articles(tokens: Column) -> Column:
    """Without the articles at the beginning."""
    text = F.regexp_replace(F.array_join(tokens, " "), "^((a|an|the)( |$))+", "")
    return F.filter(F.split(text, " "), lambda t: t != "")


def title_bonus(query: Column, title: Column) -> Column:
    q, t = lexical_tokens(query, True), strip_articles(lexical_tokens(title))
    q_text, t_text, t_set = F.array_join(q, " "), F.array_join(t, " "), F.array_distinct(t)
    shared = F.size(F.array_intersect(F.array_distinct(q), t_set))
    phrase = F.when(q_text == t_text, 2.5).when(F.contains(q_text, t_text), F.when(F.size(t) >= 2, 1.5).otherwise(1.0)).otherwise(0.0)
    whole = F.when((F.size(t_set) >= 2) & (shared == F.size(t_set)), 0.6).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(phrase + 0.8 * shared / F.greatest(F.size(t_set), F.lit(1)) + whole)


def section_bonus(query: Column, section: Column) -> Column:
    q, s = lexical_tokens(query, True), lexical_tokens(section, True)
    shared = F.size(F.array_intersect(F.array_distinct(q), F.array_distinct(s)))
    phrase = F.when((F.size(s) >= 2) & F.contains(F.array_join(q, " "), F.array_join(s, " ")), 0.5).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(s) == 0), 0.0).otherwise(0.4 * shared / F.greatest(F.size(F.array_distinct(s)), F.lit(1)) + phrase)


def rerank_text_of_chunk(title: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("Entry: "), title, F.lit("\nSection: "), section, F.lit("\nPassage: "), text)


def labelled_parts(title: Column, outline: Column, overview: Column) -> Column:
    """The parts that aren't empty, under their headings, with an empty line between them."""
    outline = F.when(outline != "", F.concat(F.lit("Section headings:\n"), outline))
    overview = F.when(overview != "", F.concat(F.lit("Overview:\n"), overview))
    return strip(F.concat_ws("\n\n", F.concat(F.lit("Entry: "), title), outline, overview))


def rerank_text_of_entry(title: Column, outline: Column, intro: Column) -> Column:
    lines = strip(F.array_join(F.slice(F.split(outline, "\n"), 1, RERANK_OUTLINE_LINES), "\n"))
    return labelled_parts(title, lines, truncate_words(intro, RERANK_OVERVIEW_WORDS))


def snippet(c: Column, n: int) -> Column:
    """On one line and at most n characters, cut after a word where one ends beyond 0.6 n, then "..."."""
    flat = F.array_join(words(c), " ")
    cut = F.substring(flat, 1, n)
    space = n - F.locate(" ", F.reverse(cut))  # place of the last space, from 0; n where there is none
    kept = F.when((F.locate(" ", cut) > 0) & (space > int(n * 0.6)), F.substring(cut, F.lit(1), space.cast("int"))).otherwise(cut)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(kept), F.lit("...")))


def uuid5(c: Column, namespace: str = ENTRY_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def cache_key(query: Column, limit: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(limit.cast("string"), F.lit("None")), F.decode(F.unhex(F.lit("00")), "UTF-8"), query), 256)


def label_of(c: Column, aliases: dict[str, str]) -> Column:
    """The label that a string is, in any of its spellings; else null."""
    spelled = F.regexp_replace(F.regexp_replace(strip(F.lower(c)), f"{WS}+", " "), "^[ .,:;]+|[ .,:;]+$", "")
    return F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), spelled)


def entry_url(url: Column) -> Column:
    """scheme://host/entries/slug/ of an entry's URL, without query and fragment; null for any other."""
    base = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)[^?#]*/entries/([^/?#]+)/*(?:[?#].*)?$"
    parts = [F.regexp_extract(url, base, i) for i in (1, 2, 3)]
    return F.when(url.rlike(base), F.concat(F.lower(parts[0]), F.lit("://"), parts[1], F.lit("/entries/"), parts[2], F.lit("/")))


def slug_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/entries/([^/?#]+)/*(?:[?#].*)?$", 1), F.lit(""))


def base_url(url: Column) -> Column:
    """What stands before the fragment."""
    return F.split_part(url, F.lit("#"), F.lit(1))


def url_parameter(url: Column, name: str) -> Column:
    """The first value of a query field; null where it is missing or blank."""
    return F.nullif(F.trim(F.try_parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit(""))


def heading_parts(heading: Column) -> Column:
    """(number, title) of a heading such as "2.3 Title"; the number is "" where there is none."""
    text, form = clean_text(heading), r"^(\d+(?:\.\d+)*)\.?[ ]+(.+)$"
    return F.struct(F.when(text.rlike(form), F.regexp_extract(text, form, 1)).otherwise("").alias("number"), F.when(text.rlike(form), F.regexp_extract(text, form, 2)).otherwise(text).alias("title"))


def first_of(*candidates: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), candidates)
