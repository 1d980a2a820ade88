"""Text expressions: tokens, slugs, HTML, routes, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that are left out when postings are built.
STOP_WORDS = sorted(
    set(
        "a an and are as at be been being but by can for from had has have her his i if in into is it its not of on or that the their them "
        "these they this those to was we were will with you your".split()
    )
)
#: Question scaffolding that coverage leaves out too.
QUESTION_WORDS = sorted(
    set(
        STOP_WORDS
        + "about also anything definition did do does explain explained facts history how important information known me often overview said tell through usually "
        "what when where which while who why without work works".split()
    )
)
#: Shortest word that coverage counts, and what a word weighs that the corpus uses everywhere.
COVERAGE_LENGTH, COMMON_WEIGHT = 3, 1.0 / 3
#: Seeds of the two hashes of a bloom filter.
BLOOM_SEEDS = (0, 0x9E3779B9)
CHROME = ("script", "style", "nav", "header", "footer", "aside")


def lexical_tokens(text: Column, stop_words: bool = False) -> Column:
    """Runs of ``a-z0-9'`` in lower case, 2 to 32 characters."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), lambda w: F.length(w).between(2, 32))
    return F.filter(tokens, lambda w: ~w.isin(STOP_WORDS)) if stop_words else tokens


def all_tokens(text: Column) -> Column:
    """Runs of ``a-z0-9'`` of any length, as calibration counts them."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def content_words(text: Column) -> Column:
    """Words that coverage asks for, repeats included."""
    return F.filter(all_tokens(text), lambda w: (F.length(w) >= COVERAGE_LENGTH) & ~w.isin(QUESTION_WORDS))


def word_forms(word: Column) -> Column:
    """A word, its plurals, and its singular: any of them grounds it."""
    forms = F.array(word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)))
    return F.array_compact(forms)


def normalise_text(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, "\r", ""), "[ \t]+", " ")
    return F.btrim(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit(" \t\n"))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def decode_entities(text: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_title(html: Column) -> Column:
    return normalise_text(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_links(html: Column) -> Column:
    """Double-quoted targets as they are written."""
    return F.regexp_extract_all(html, F.lit(r'(?i)href\s*=\s*"([^"]*)"'), F.lit(1))


def link_targets(html: Column) -> Column:
    """Targets in double quotes, single quotes or none."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+)"""), F.lit(1))
    return F.transform(raw, lambda t: F.regexp_replace(t, r"""^["']|["']$""", ""))


def meta_refresh(html: Column) -> Column:
    """Where a page's refresh tag leads, as it is written; null if there is none."""
    tag = F.regexp_extract(html, r"""(?i)<meta[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>""", 0)
    target = F.regexp_extract(tag, r"""(?i)content\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'>\s;]+)""", 1)
    return F.when(target != "", target)


def url_pattern(patterns: list[str]) -> str:
    """Patterns over whole URL paths, ``*`` alone a wildcard, as one regular expression."""
    one = lambda p: ".*".join("".join("\\" + c if c in r".+?^${}()|[]\\" else c for c in part) for part in p.split("*"))
    return "^(?:" + "|".join(map(one, patterns)) + ")$" if patterns else "(?!)"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)?", 1)


def crawlable(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a crawl takes a URL; print pages, which repeat a whole site, are always left out."""
    path = url_path(url)
    allowed = ~path.rlike(url_pattern(["*/print.html", *(exclude or [])]))
    return allowed & path.rlike(url_pattern(include)) if include else allowed


def html_body(html: Column) -> Column:
    """The main part without page furniture."""
    parts = [F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1) for t in ("main", "article", "body")]
    body = F.coalesce(*(F.when(p != "", p) for p in parts), html)
    for tag in CHROME:
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return body


def html_text(html: Column) -> Column:
    body = F.regexp_replace(html_body(html), r"(?i)<br\s*/?>", "\n")
    body = F.regexp_replace(body, r"(?i)</(p|li|div|tr|pre)>", "\n")
    return normalise_text(decode_entities(F.regexp_replace(body, "<[^>]+>", " ")))


def strip_markdown(text: Column) -> Column:
    """Text without markup: images go, links keep their words."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return normalise_text(F.regexp_replace(text, "[#>*_`~-]", " "))


def slug(heading: Column) -> Column:
    """Heading anchor: letters, digits, spaces as dashes; no duplicates removed."""
    heading = F.lower(F.btrim(F.coalesce(heading, F.lit(""))))
    return F.replace(F.regexp_replace(heading, r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def route(path: Column) -> Column:
    """Site route of a source path: no extension, no ordering prefixes, no index page."""
    path = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"(?i)\.(md|mdx|html|txt)$", "")
    path = F.regexp_replace(path, r"(^|/)[0-9]+-", "$1")
    return F.regexp_replace(F.regexp_replace(path, r"(?i)(^|/)(index|readme)$", "$1"), "/+$", "")


def glob_regex(pattern: str) -> str:
    """A path glob (``**``, ``*``, ``?``) as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+^$()[]{}|\\" else c
            i += 1
    return f"^{out}$"


def fnv1a(word: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a of an ASCII word; the seed is mixed into the start."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5 ^ seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def term_key(word: Column) -> Column:
    """One signed 64-bit key of two hashes."""
    return F.shiftleft(fnv1a(word, BLOOM_SEEDS[0]), 32).bitwiseOR(fnv1a(word, BLOOM_SEEDS[1]))


def bloom_places(word: Column, bits: int) -> Column:
    """The bits of a word in a filter of so many (a power of two)."""
    return F.array(*(fnv1a(word, seed) % bits for seed in BLOOM_SEEDS))


def bloom_bits(words: int, least: int = 1 << 14, most: int = 1 << 21) -> int:
    """Bits of a filter for so many words: 32 each, a power of two within bounds."""
    bits = least
    while bits < 32 * words and bits < most:
        bits *= 2
    return bits


def clean_title(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*[/|>]\s*", " "), F.lit(" \t\n\r"))


def first_sentence(text: Column, words_at_most: int = 28) -> Column:
    text = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), F.lit(" "))
    return F.array_join(F.slice(F.split(F.element_at(F.split(text, r"(?<=[.!?])\s+", 2), 1), " "), 1, words_at_most), " ")


def keywords(text: Column, most: int = 10) -> Column:
    """The first distinct words of three letters or more, without function words."""
    found = F.filter(F.array_distinct(all_tokens(text)), lambda w: (F.length(w) >= 3) & ~w.isin(QUESTION_WORDS))
    return F.array_join(F.slice(found, 1, most), " ")


def word_dropout(text: Column, key: Column, rate: float = 0.22) -> Column:
    """A text without about ``rate`` of its words, chosen by hashes of key and place; a text left with under 3 keeps its first 6."""
    all_words = words(text)
    kept = F.filter(all_words, lambda w, i: F.pmod(F.xxhash64(key, i, w), F.lit(10_000)) >= int(rate * 10_000))
    return F.array_join(F.when(F.size(kept) < F.least(F.lit(3), F.size(all_words)), F.slice(all_words, 1, 6)).otherwise(kept), " ")


def folded_query(text: Column) -> Column:
    """A query text by which repeats are told: lower case, single spaces."""
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def little_endian_u32(hex_digest: Column) -> Column:
    turned = F.concat(*(F.substring(hex_digest, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(turned, 16, 10).cast("long")
