"""Splitting of agreements and legal texts into addressable chunks, and what changed between two versions.

Headings are found and sections formed in column expressions over each document's lines; a document
is one row throughout, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.text import checksum, trimmed, without_tanween

# Heading forms, in the order in which they are tried; limits of chunks.
CONTRACT_ORDINALS = "أولاً|أولا|ثانياً|ثانيا|ثالثاً|ثالثا|رابعاً|رابعا|خامساً|خامسا|سادساً|سادسا|سابعاً|سابعا|ثامناً|ثامنا|تاسعاً|تاسعا|عاشراً|عاشرا"
LEGAL_ORDINALS = "أولا|ثانيا|ثالثا|رابعا|خامسا|سادسا|سابعا|ثامنا|تاسعا|عاشرا|حادي عشر|ثاني عشر|ثالث عشر|رابع عشر|خامس عشر"
_TAIL = r"\s*[:.\-–]?\s*(.*)$"
CONTRACT_HEADINGS = (
    (rf"^\s*(({CONTRACT_ORDINALS})){_TAIL}", 3),
    (rf"^\s*((المادة|البند)\s+[^\s:.\-–]+){_TAIL}", 3),
    (rf"(?i)^\s*((Section|Clause|Article)\s+[0-9]+[A-Za-z]?){_TAIL}", 3),
    (r"^\s*(([0-9]{1,3}))[.)\-]\s+(.*)$", 3),
)
CHAPTER = r"(?i)^\s*(Chapter|Section)\s+.+$|^\s*(الفصل|القسم|الباب)\s+.+$"
LEGAL_ENGLISH = rf"(?i)^\s*Article\s+([0-9]+[A-Za-z]?){_TAIL}"
LEGAL_ARABIC = rf"^\s*المادة\s+([^\n:.\-–]+){_TAIL}"
LEGAL_ORDINAL = rf"^\s*({LEGAL_ORDINALS}){_TAIL}"
CONTRACT_LIMIT, CONTRACT_OVERLAP, CONTRACT_LEAST = 2000, 150, 20
LEGAL_LIMIT = 3500
PARAGRAPHS = r"\n{2,}"


def _lines(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def _contract_line(line: Column) -> Column:
    """struct(label, tail): null label for a line that is no heading."""
    label = tail = None
    for pattern, tail_group in reversed(CONTRACT_HEADINGS):
        words = F.regexp_replace(F.regexp_extract(line, pattern, 1), r"\s+", " ")
        here, rest = line.rlike(pattern), trimmed(F.regexp_extract(line, pattern, tail_group))
        label, tail = F.when(here, words).otherwise(label), F.when(here, rest).otherwise(tail)
    return F.struct(label.cast("string").alias("label"), F.lit(None).cast("string").alias("chapter"), tail.cast("string").alias("tail"), line.alias("line"))


def _legal_line(line: Column) -> Column:
    plain = without_tanween(line)
    chapter = line.rlike(CHAPTER)
    label = (
        F.when(chapter, None)
        .when(line.rlike(LEGAL_ENGLISH), F.concat(F.lit("Article "), F.regexp_extract(line, LEGAL_ENGLISH, 1)))
        .when(line.rlike(LEGAL_ARABIC), F.concat(F.lit("المادة "), trimmed(F.regexp_extract(line, LEGAL_ARABIC, 1))))
        .when(plain.rlike(LEGAL_ORDINAL), F.regexp_extract(plain, LEGAL_ORDINAL, 1))
    )
    tail = F.when(line.rlike(LEGAL_ENGLISH), F.regexp_extract(line, LEGAL_ENGLISH, 2)).when(line.rlike(LEGAL_ARABIC), F.regexp_extract(line, LEGAL_ARABIC, 2)).when(plain.rlike(LEGAL_ORDINAL), F.regexp_extract(plain, LEGAL_ORDINAL, 2))
    return F.struct(label.alias("label"), F.when(chapter, trimmed(line)).alias("chapter"), trimmed(tail).alias("tail"), line.alias("line"))


def _sections(lines: Column) -> Column:
    """array<struct(label, chapter, body)> in order: a heading opens a section, which takes the lines
    up to the next; lines before the first heading belong to none; a chapter line names the chapter of
    the sections after it."""
    kind = "struct<label:string,chapter:string,body:array<string>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"), F.lit(None).cast("string").alias("chapter"))

    def step(s: Column, x: Column) -> Column:
        closed = F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        opened = F.struct(x["label"].alias("label"), s["chapter"].alias("chapter"), F.when(x["tail"] != "", F.array(x["tail"])).otherwise(F.array().cast("array<string>")).alias("body"))
        longer = F.when(s["open"].isNotNull(), F.struct(s["open"]["label"].alias("label"), s["open"]["chapter"].alias("chapter"), F.concat(s["open"]["body"], F.array(x["line"])).alias("body")))
        new = x["label"].isNotNull()
        return F.struct(F.when(new, closed).otherwise(s["done"]).alias("done"), F.when(new, opened).when(x["chapter"].isNotNull(), s["open"]).otherwise(longer).alias("open"), F.coalesce(x["chapter"], s["chapter"]).alias("chapter"))

    finish = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    joined = lambda x: F.struct(x["label"].alias("label"), x["chapter"].alias("chapter"), trimmed(F.array_join(x["body"], "\n")).alias("body"))
    return F.transform(F.aggregate(lines, start, step, finish), joined)


def split_oversized(body: Column, limit: int, overlap: int = 0) -> Column:
    """Paragraphs packed into parts of up to ``limit`` characters; a part after the first begins with the
    last ``overlap`` characters of the one before. A paragraph longer than the limit stays whole."""
    paragraphs = F.filter(F.transform(F.split(body, PARAGRAPHS), trimmed), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        longer = F.when(s["now"] == "", p).otherwise(F.concat(s["now"], F.lit("\n\n"), p))
        full = (F.length(longer) > limit) & (s["now"] != "")
        fresh = F.concat(F.right(s["now"], F.lit(overlap)), F.lit("\n\n"), p) if overlap else p
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full, fresh).otherwise(longer).alias("now"))

    packed = F.aggregate(paragraphs, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.length(body) <= limit, F.array(body)).when(F.size(packed) > 0, packed).otherwise(F.array(F.left(body, F.lit(limit))))


def _chunks(rows: DataFrame, parent: str, text: str, line_of, limit: int, overlap: int, least: int, labelled_only: bool) -> DataFrame:
    sections = _sections(F.transform(_lines(F.col(text)), line_of))
    whole = F.filter(F.transform(F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), PARAGRAPHS), trimmed), lambda p: F.length(p) >= max(least, 1))
    found = rows.withColumn("_sections", sections).withColumn("_bodies", F.filter("_sections", lambda s: s["body"] != ""))
    structured = F.size("_sections") > 0 if labelled_only else F.size("_bodies") > 0
    plain = F.transform(whole, lambda p: F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("chapter"), p.alias("body")))
    found = found.withColumn("_structured", structured).withColumn("_units", F.when(structured, F.col("_bodies")).otherwise(plain))
    parts = F.flatten(F.transform("_units", lambda u: F.transform(split_oversized(u["body"], limit, overlap), lambda p: F.struct(u["label"].alias("section"), u["chapter"].alias("chapter"), p.alias("text")))))
    parts = F.filter(parts, lambda p: F.length(trimmed(p["text"])) >= least)
    out = found.select(F.col(parent), "_structured", F.posexplode(parts).alias("chunk_order", "part"))
    place = F.coalesce(F.regexp_replace("part.section", r"\s+", "_"), F.concat(F.lit("p"), F.col("chunk_order").cast("string")))
    return out.select(
        F.col(parent),
        F.concat_ws("::", F.col(parent).cast("string"), place, F.col("chunk_order").cast("string")).alias("chunk_id"),
        "chunk_order",
        F.col("part.section").alias("section"),
        F.col("part.chapter").alias("chapter"),
        F.col("part.text").alias("chunk_text"),
        checksum(F.col("part.text")).alias("checksum"),
        (~F.col("_structured")).alias("needs_manual_review"),
    )


def chunk_contracts(rows: DataFrame, parent: str, text: str = "text") -> DataFrame:
    """Chunks of agreements: a section per heading, cut at 2,000 characters with 150 of overlap, or
    paragraphs where no heading has a body. Chunks under 20 characters are left out."""
    return _chunks(rows, parent, text, _contract_line, CONTRACT_LIMIT, CONTRACT_OVERLAP, CONTRACT_LEAST, False)


def chunk_legal_texts(rows: DataFrame, parent: str, text: str = "text") -> DataFrame:
    """Chunks of legal texts: an article per heading under the chapter before it, cut at 3,500
    characters, or paragraphs, marked for review, where no article heading occurs."""
    return _chunks(rows, parent, text, _legal_line, LEGAL_LIMIT, 0, 1, True)


def line_chunks(rows: DataFrame, parent: str, text: str = "text", least: int = CONTRACT_LEAST) -> DataFrame:
    """A chunk per non-empty line of at least ``least`` characters, numbered in order."""
    lines = F.filter(F.transform(_lines(F.col(text)), trimmed), lambda x: F.length(x) >= least)
    out = rows.select(parent, F.posexplode(lines).alias("chunk_order", "chunk_text"))
    return out.withColumns({"chunk_id": F.concat(F.col(parent).cast("string"), F.lit("::p"), F.col("chunk_order").cast("string"), F.lit("::"), F.col("chunk_order").cast("string")), "checksum": checksum(F.col("chunk_text"))})


def diff_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """chunk_id, action for ``new`` and ``stored`` (chunk_id, checksum): 'reuse' where both agree,
    'embed' for new or changed content, 'drop' for ids that are gone. One join on the id."""
    both = new.select("chunk_id", F.col("checksum").alias("n")).join(stored.select("chunk_id", F.col("checksum").alias("s")), "chunk_id", "full_outer")
    return both.select("chunk_id", F.when(F.col("n").isNull(), "drop").when(F.col("n") == F.col("s"), "reuse").otherwise("embed").alias("action"))
