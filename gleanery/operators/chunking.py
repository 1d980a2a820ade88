"""From pages and documents to chunks: sections, windows, dedupe, addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._shared import shared_table
from .._ship import ship
from ..errors import check_range
from ..functions.text import normalise_text, slug, words

MIN_TOKENS = 25


def token_windows(df: DataFrame, target: int = 256, overlap_percent: int = 15) -> DataFrame:
    """``doc_id, chunk, n_tokens, text``: sliding windows over white-space tokens.

    Documents under 25 tokens are left out (see ``short_documents``).
    """
    check_range("target", target, 1, 1 << 20)
    step = max(1, target - target * overlap_percent // 100)
    tokens = df.select("doc_id", words(normalise_text(F.col("text"))).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    last = F.greatest(F.lit(0), F.ceil((F.size("tokens") - target) / step)).cast("int")
    windows = tokens.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    cut = windows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.slice("tokens", F.col("chunk") * step + 1, target).alias("w"))
    return cut.select("doc_id", "chunk", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("text"))


def short_documents(df: DataFrame) -> DataFrame:
    """``doc_id, tokens`` of documents too short to chunk."""
    return df.select("doc_id", F.size(words(normalise_text(F.col("text")))).cast("long").alias("tokens")).where(F.col("tokens") < MIN_TOKENS)


def first_of_equal_texts(df: DataFrame) -> DataFrame:
    """``doc_id, text_sha`` of the first document of each text, by digest: no text is shuffled."""
    digests = df.select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return digests.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "text_sha", "copies")


def unique_slugs(headings: DataFrame) -> DataFrame:
    """Adds ``slug`` to ``doc_id, position, heading``: repeats in a document get -1, -2, ..."""
    based = headings.withColumn("base", slug(F.col("heading")))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("position")) - 1
    numbered = based.withColumn("n", n)
    return numbered.withColumn("slug", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))).drop("n")


def renumbered(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks with ``id`` anew: dense from 0 in the order of ``order``, the first of equal texts only.

    Equal texts meet by their digests, and numbers come from counts of ordered
    ranges, so that neither a text nor a table passes through one task.
    """
    first = chunks.withColumn("__sha", F.sha2("text", 256)).groupBy("__sha").agg(F.min(F.struct(*order)).alias("__first")).select("__first.*")
    return dense_ids(chunks.drop("id").join(first, order, "left_semi"), order)


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with ``name``: dense numbers from ``start`` in a total order.

    Ranges are sorted apart; each begins at the sum of the rows before it, of which
    there is one number a partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = shared_table(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__seq")), "ranges")
    counts = sorted((r["__part"], r["n"], r["s"]) for r in stored.groupBy("__part").agg(F.count("*").alias("n"), F.min("__seq").alias("s")).collect())
    offsets, total = [], start
    for part, n, first in counts:
        offsets.append((part, total - first))
        total += n
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("__part")) if offsets else F.lit(0)
    return stored.withColumn(name, (F.col("__seq") + shift).cast("long")).drop("__part", "__seq")


_FENCE, _ATX, _SETEXT = re.compile(r"^\s*(```|~~~)"), re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"^(=+|-+)\s*$")
_CUSTOM = re.compile(r"\s*\{#([\w-]+)\}\s*$")


def plain_text(text: str) -> str:
    """Collapsed blanks, at most one empty line."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\r", ""))).strip()


def unmarked(text: str) -> str:
    """Markdown without its marks."""
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", text)
    return plain_text(re.sub(r"[#>*_`~-]", " ", re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", text)))


def heading_slug(heading: str) -> str:
    return re.sub(r"[^\w _-]", "", heading.strip().lower()).replace(" ", "-")


def with_paths(raw: list[dict], title: str, clean) -> list[dict]:
    """Sections with heading paths and anchors; text begins with the heading.

    ``raw``: ``depth`` (0 before the first heading), ``heading``, ``anchor``, ``body``.
    A first heading of depth 1 that repeats the title is no part of the paths.
    Anchors that headings lack are slugs, numbered where they repeat.
    """
    used: dict[str, int] = {}
    path: list[tuple[int, str]] = []
    out, titled = [], False
    for s in raw:
        if not s["depth"]:
            if text := clean(s["body"]):
                out.append({"path": [], "heading": "", "anchor": "", "text": text})
            continue
        anchor = s["anchor"]
        if not anchor:
            base = heading_slug(s["heading"])
            n = used[base] = used.get(base, -1) + 1
            anchor = f"{base}-{n}" if n else base
        is_title = s["depth"] == 1 and not titled and bool(title) and s["heading"].lower() == title.lower()
        titled = titled or s["depth"] == 1
        path = [p for p in path if p[0] < s["depth"]]
        own = [] if is_title else [*(h for _, h in path if h), s["heading"]]
        path.append((s["depth"], "" if is_title else s["heading"]))
        text = clean(f"{s['heading']}\n{s['body']}" if s["heading"] else s["body"])
        if text or s["heading"]:
            out.append({"path": own, "heading": s["heading"], "anchor": anchor, "text": text})
    return out


def markdown_sections(text: str) -> list[dict]:
    """Sections of a markdown text: heading path, heading, anchor, text.

    Front matter, imports, exports and component tags are dropped; fenced lines are
    never headings.
    """
    body, title = text.replace("\r", ""), ""
    if front := re.match(r"---\n(.*?)\n---(?:\n|$)", body, re.S):
        body = body[front.end() :]
        named = re.search(r"""^title:\s*["']?([^"'\n]+?)["']?\s*$""", front[1], re.M)
        title = named[1] if named else ""
    body = re.sub(r"^(?:import|export)\s[^\n]*$", " ", body, flags=re.M)
    body = re.sub(r"</?[A-Z][A-Za-z0-9.]*(?:\s[^>]*?)?/?>", " ", body)
    raw: list[dict] = [{"depth": 0, "heading": "", "anchor": "", "body": []}]
    fence = None
    for line in body.split("\n"):
        mark = _FENCE.match(line)
        if mark and fence in (None, mark.group(1)):
            fence = None if fence else mark.group(1)
        heading = depth = None
        if fence is None and not mark:
            before = raw[-1]["body"]
            if atx := _ATX.match(line):
                depth, heading = len(atx.group(1)), atx.group(2)
            elif _SETEXT.match(line) and before and before[-1].strip():
                depth, heading = 1 if line.startswith("=") else 2, before.pop().strip()
        if heading is None:
            raw[-1]["body"].append(line)
            continue
        custom = _CUSTOM.search(heading)
        raw.append({"depth": depth, "heading": unmarked(_CUSTOM.sub("", heading)), "anchor": custom.group(1) if custom else "", "body": []})
    title = title or next((s["heading"] for s in raw if s["depth"] == 1), "")
    return with_paths([{**s, "body": "\n".join(s["body"])} for s in raw], title, unmarked)


_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def _entities(text: str) -> str:
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return text


def _flat_html(fragment: str) -> str:
    fragment = re.sub(r"</(?:p|li|div|tr|pre)>", "\n", re.sub(r"<br\s*/?>", "\n", fragment, flags=re.I), flags=re.I)
    return plain_text(_entities(re.sub(r"<[^>]+>", " ", fragment)))


def _attribute(tag: str, name: str) -> str:
    found = re.search(rf"""\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'<>=`]+))""", tag, re.I)
    return next((g for g in found.groups()[1:] if g is not None), "") if found else ""


def html_sections(html: str) -> list[dict]:
    """Sections of a page's main part between its headings; an ``id`` on a heading or inside it is the anchor."""
    title = re.search(r"<title[^>]*>(.*?)</title>", html, re.I | re.S)
    title = plain_text(_entities(title[1])) if title else ""
    main = re.search(r"<(main|article)[^>]*>(.*?)</\1>", html, re.I | re.S)
    whole = re.search(r"<body[^>]*>(.*?)</body>", html, re.I | re.S)
    body = main[2] if main else whole[1] if whole else html
    body = re.sub(r"<(script|style|nav|header|footer|aside)[^>]*>.*?</\1>", " ", body, flags=re.I | re.S)
    raw, at, last = [], 0, {"depth": 0, "heading": "", "anchor": ""}
    for m in re.finditer(r"<h([1-6])([^>]*)>(.*?)</h\1>", body, re.I | re.S):
        raw.append({**last, "body": body[at : m.start()]})
        heading = plain_text(_entities(re.sub(r"<[^>]+>", " ", m[3])))
        last, at = {"depth": int(m[1]), "heading": heading, "anchor": _attribute(m[2], "id") or _attribute(m[3], "id")}, m.end()
    raw.append({**last, "body": body[at:]})
    return with_paths(raw, re.split(r"\s*[|·–—-]\s+", title)[0] or title, _flat_html)


def resolved_links(html: str, base: str) -> list[str]:
    """Absolute targets on the page's own origin, without fragments, in order."""
    from urllib.parse import urldefrag, urljoin, urlsplit

    out = []
    for m in re.finditer(r"""href\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'<>=`]+))""", html, re.I):
        try:
            url = urldefrag(urljoin(base, next(g for g in m.groups()[1:] if g is not None))).url
            to, home = urlsplit(url), urlsplit(base)
            if to.scheme in ("http", "https") and (to.scheme, to.netloc.lower()) == (home.scheme, home.netloc.lower()):
                out.append(url)
        except ValueError:
            continue
    return out


def sentence_chunks(title: str, text: str, target: int = 800, least: int = 120) -> list[str]:
    """Sentences joined up to ``target`` characters, each chunk begun by the title; the last may be short."""
    held: list[str] = []
    size, out = 0, []
    for sentence in re.split(r"(?<=[.!?])\s+", re.sub(r"\n{2,}", "\n", text).strip().replace("\n", " ")):
        if not (sentence := sentence.strip()):
            continue
        if size + len(sentence) > target and size >= least:
            out.append(f"{title}: " + " ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += len(sentence) + 1
    return out + [f"{title}: " + " ".join(held)] if held else out


def section_chunks(sections: list[dict], target: int = 256, overlap_percent: int = 15) -> list[tuple[list[str], str, str]]:
    """(path, anchor, text) chunks: sections up to 1.6 targets stay whole, longer ones are
    cut at paragraphs, longer paragraphs into windows; tiny sections join their predecessor.
    A document of under 25 tokens gives none."""
    keep, step = target * 8 // 5, max(1, target - target * overlap_percent // 100)
    if sum(len(s["text"].split()) for s in sections) < MIN_TOKENS:
        return []
    out: list[list] = []
    for s in sections:
        n = len(s["text"].split())
        if not n:
            continue
        if n < MIN_TOKENS and out:
            out[-1][2] += "\n" + s["text"]
        elif n <= keep:
            out.append([s["path"], s["anchor"], s["text"]])
        else:
            held: list[str] = []
            for part in [*re.split(r"\n{2,}", s["text"]), None]:
                size = len(part.split()) if part is not None else 0
                if held and (part is None or size > keep or sum(len(h.split()) for h in held) + size > target):
                    out.append([s["path"], s["anchor"], "\n\n".join(held)])
                    held = []
                if part is None or not size:
                    continue
                if size > keep:
                    tokens = part.split()
                    for at in range(0, max(1, len(tokens) - target + step), step):
                        out.append([s["path"], s["anchor"], " ".join(tokens[at : at + target])])
                else:
                    held.append(part)
    return [tuple(x) for x in out]


PARSERS = {"markdown": markdown_sections, "html": html_sections}


def _per_row(df: DataFrame, columns: list, fn, names: list[str], types: list, schema: str) -> DataFrame:
    """``fn`` of each row's columns to output rows, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)) for r in fn(*row)]
                out = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def sections(df: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, position, path, heading, anchor, text`` of each document's sections."""
    parse = PARSERS[kind]
    fn = lambda i, text: [(i, n, s["path"], s["heading"], s["anchor"], s["text"]) for n, s in enumerate(parse(text or ""))]
    names = ["doc_id", "position", "path", "heading", "anchor", "text"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    return _per_row(df, [id_col, text_col], fn, names, types, "doc_id long, position long, path array<string>, heading string, anchor string, text string")


def chunk_documents(df: DataFrame, kind: str = "markdown", target: int = 256, overlap_percent: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk, heading_path, anchor, text`` of markdown or HTML documents, each in its own row."""
    parse = PARSERS[kind]
    fn = lambda i, text: [(i, n, *c) for n, c in enumerate(section_chunks(parse(text or ""), target, overlap_percent))]
    names = ["doc_id", "chunk", "heading_path", "anchor", "text"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
    return _per_row(df, [id_col, text_col], fn, names, types, "doc_id long, chunk long, heading_path array<string>, anchor string, text string")


def chunk_markdown(df: DataFrame, target: int = 256, overlap_percent: int = 15) -> DataFrame:
    """``doc_id, chunk, heading_path, anchor, text`` of markdown documents."""
    return chunk_documents(df, "markdown", target, overlap_percent)


def chunk_sentences(df: DataFrame, target: int = 800, least: int = 120) -> DataFrame:
    """``doc_id, chunk, text`` of ``doc_id, title, text``, in whole sentences."""
    fn = lambda i, title, text: [(i, n, c) for n, c in enumerate(sentence_chunks(title or "", text or "", target, least))]
    return _per_row(df, ["doc_id", "title", "text"], fn, ["doc_id", "chunk", "text"], [pa.int64(), pa.int64(), pa.string()], "doc_id long, chunk long, text string")


def links(df: DataFrame) -> DataFrame:
    """``page_id, position, link`` of ``page_id, url, html``: same-origin targets, resolved."""
    fn = lambda i, url, html: [(i, n, x) for n, x in enumerate(resolved_links(html or "", url or ""))]
    return _per_row(df, ["page_id", "url", "html"], fn, ["page_id", "position", "link"], [pa.int64(), pa.int64(), pa.string()], "page_id long, position long, link string")


def public_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks as results show them: with title, address, source and the first 220 characters.

    ``documents``: ``doc_id, title, url, source_path``.
    """
    both = chunks.join(documents.select("doc_id", "title", "url", "source_path"), "doc_id", "left")
    address = F.coalesce("url", "source_path")
    return both.select("id", "doc_id", "title", "heading_path", address.alias("url"), "anchor", F.coalesce("source_path", "url").alias("source_path"), "text", F.substring("text", 1, 220).alias("preview"))
