"""Text columns: folding, word tests, cleanup, links and headlines in free text.

All but ``words_in`` stay in the JVM. ``bind`` and ``materialize`` exist because Catalyst re-expands an
alias wherever a filter above a projection refers to it: a rule table that looks at one long text
a hundred times would then lower-case that text a hundred times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import rules

# Python's regex classes are Unicode-aware; (?U) gives Java the same reading of \b, \d and \s.
UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"

# Fixed value: the characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Bytes that are looked at together.
BLOCK = 1 << 20


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def materialize(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, below any filter on them.

    A one-element ``inline`` is a generator, and predicates are not pushed through the output of a
    generator, so the optimizer cannot copy the expressions into each use.
    """
    fields = [c.alias(name) for name, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def quote(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def word_array(words: Iterable[str]) -> Column:
    """Literal array of words, built in one step."""
    quoted = [quote(w) for w in words]
    return F.expr(f"array({', '.join(quoted)})") if quoted else F.expr("cast(array() as array<string>)")


def any_word(text: Column, words: Iterable[str]) -> Column:
    """True when at least one of the words occurs anywhere in the text (substring test).

    ``text`` should be a plain column or a bound value: it is read once per word, until one hits.
    """
    return F.exists(word_array(words), lambda word: text.contains(word))


def words_found(column: str, words: Iterable[str]) -> Column:
    """The words that occur in a text column, as an array: one compiled scan per distinct word."""
    tests = [f"if(contains({column}, {quote(w)}), {quote(w)}, null)" for w in dict.fromkeys(words)]
    return F.expr(f"array_compact(array({', '.join(tests)}))")


def hits(data: np.ndarray, needles: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a needle, places in the bytes where it begins); a needle may come several times.

    One pass tells where the first two bytes of any needle stand; only there further bytes are compared.
    """
    groups: dict[bytes, list[int]] = {}
    for i, needle in enumerate(needles):
        if len(needle) < 2:
            yield i, np.flatnonzero(data == needle[0]) if needle else np.arange(len(data))
        else:
            groups.setdefault(needle[:2], []).append(i)
    table = np.zeros(1 << 16, np.uint16)
    table[[pair[0] << 8 | pair[1] for pair in groups]] = np.arange(1, len(groups) + 1)
    data = np.concatenate([data, np.zeros(max(map(len, needles), default=0), np.uint8)])
    for start in range(0, len(data), BLOCK):
        block = data[start : start + BLOCK + 1]
        group = table[block[:-1].astype(np.uint16) << 8 | block[1:]]
        at = np.flatnonzero(group)
        order = np.argsort(group[at], kind="stable")
        ends = np.cumsum(np.bincount(group[at], minlength=len(groups) + 1))
        for g, members in enumerate(groups.values()):
            first = at[order[ends[g] : ends[g + 1]]] + start
            for i in members if len(first) else ():
                places = first
                for k in range(2, len(needles[i])):
                    places = places[data[places + k] == needles[i][k]]
                if len(places):
                    yield i, places


def words_in(text: Column, words: Iterable[str]) -> Column:
    """``words_found`` for long texts: one pass over a batch of them finds all words; the JVM's looks at each byte for every word.

    Texts are compared as bytes, as the JVM does; a null text holds none.
    """
    words = list(dict.fromkeys(words))
    needles = [word.encode() for word in words]

    def found(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null(b"").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, held = ends - ends[0], np.zeros((len(texts), len(words)), bool)
        for i, places in hits(data, needles):
            row = np.searchsorted(ends, places, "right") - 1
            held[row[places + len(needles[i]) <= ends[row + 1]], i] = True
        offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(words, pa.string()).take(pa.array(np.nonzero(held)[1])))

    return F.arrow_udf(found, "array<string>")(text.cast("binary"))


def has_any(column: str, words: Iterable[str]) -> str:
    """SQL test on an array column made by ``words_found``."""
    return f"arrays_overlap({column}, array({', '.join(quote(w) for w in words)}))"


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike((UNICODE_NOCASE if ignore_case else UNICODE) + pattern)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_chars(text: Column, chars: str, left: bool = True) -> Column:
    """Remove any of the given characters at the right end, and also at the left if asked."""
    return F.btrim(text, F.lit(chars)) if left else F.rtrim(text, F.lit(chars))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def fold_hint(text: Column) -> Column:
    """Lower case, with dashes and underscores read as spaces."""
    return strip(F.translate(F.lower(text), "-_", "  "))


def title_slug(title: Column) -> Column:
    """Comparison form of a title: lower-case letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def normalized_location(location: Column) -> Column:
    """White space collapsed; an empty location is null."""
    return F.when(F.length(location) > 0, collapse(location))


def is_remote(location: Column, words: Iterable[str] = rules.REMOTE_WORDS) -> Column:
    """Remote flag; a hybrid place counts as remote."""
    return F.coalesce(
        bind(F.lower(collapse(location)), lambda place: any_word(place, words)), F.lit(False)
    )


def title_case(text: Column) -> Column:
    """Upper case after anything that is not a letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def strip_markup(html: Column) -> Column:
    """Cheap tag removal for table cells: tags become breaks, five common entities are read."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapse(bare)


def first_link(html: Column) -> Column:
    """The first quoted or bare href of an anchor, or null."""
    href = F.regexp_extract(
        html, r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1
    )
    return null_if_empty(strip(F.replace(strip_chars(href, "\"'"), F.lit("&amp;"), F.lit("&"))))


def job_text(title: Column, description: Column, location: Column) -> Column:
    """Lower-case title, description and place, the text that rules read."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, description, location)]
    return F.lower(F.concat_ws(" ", *parts))


def plain_summary(value: Column) -> Column:
    """Drop control characters and typographic punctuation, collapse white space."""
    bare = F.regexp_replace(value, r"[\x00-\x1f\x7f-\x9f]\d?", " ")
    return collapse(F.translate(bare, "–—‑‘’", "---''"))


def _upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def readable_summary(value: Column, label: str) -> Column:
    """At most two plain sentences without the leading ``<label> n/100`` prefix."""
    bare = plain_summary(value)
    bare = F.regexp_replace(bare, rf"(?i)^{label}\s+\d+/100\s*[-:]*\s*", "")
    bare = strip_chars(collapse(F.regexp_replace(bare, r";\s*", ". ")), " .-")

    def sentences(text: Column) -> Column:
        parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda part: part != "")
        return F.array_join(F.slice(F.transform(parts, _upper_first), 1, 2), " ")

    def close(text: Column) -> Column:
        return (
            F.when(text == "", F.lit("No additional detail was available."))
            .when(text.rlike(r"[.!?]$"), text)
            .otherwise(F.concat(text, F.lit(".")))
        )

    return bind(bind(bare, sentences), close)


def links_in_text(text: Column) -> Column:
    """Distinct links in order of appearance, bare domains included, always with a scheme."""
    raw = F.regexp_extract_all(
        text, F.lit(UNICODE_NOCASE + "(" + rules.FREE_TEXT_URL_PATTERN + ")"), F.lit(1)
    )

    def finish(link: Column) -> Column:
        bare = strip_chars(link, ".,;:!?\"')]}>", left=False)
        return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))

    return F.array_distinct(F.transform(raw, finish))


def mentions_job(text: Column, links: Column, terms: Iterable[str] = rules.JOB_TERMS) -> Column:
    """Short items count as relevant with any link or any job term."""
    return (F.size(links) > 0) | bind(F.lower(text), lambda low: any_word(low, terms))


def headline(text: Column, default: str = "New Story", terms: Iterable[str] = rules.JOB_TERMS) -> Column:
    """First line of 8 to 110 characters that names a job term, else the first such line."""
    lines = F.transform(
        F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"),
        lambda line: strip_chars(F.regexp_replace(line, r"(?U)\s+", " "), " .,:;|-"),
    )

    def usable(line: Column) -> Column:
        return F.length(line).between(8, 110) & line.rlike("[A-Za-z]{3}")

    def choose(found: Column) -> Column:
        with_term = F.filter(found, lambda line: bind(F.lower(line), lambda low: any_word(low, terms)))
        return F.coalesce(F.get(with_term, F.lit(0)), F.get(found, F.lit(0)), F.lit(default))

    return bind(F.filter(lines, usable), choose)
