"""Translation-memory files as entries and units.

Files are read by Spark's text source with entries' end tag as the line separator, so one
file is split over many tasks and any number of files is one scan. A record is cut from its
first entry tag on, cleared of the control characters that XML forbids, and parsed by itself
in an Arrow pass, which also numbers the entries of each block of a file; what can't be
parsed is reported in a column, not dropped. An entry's ordinal is the number of entries
before its block, a prefix sum over the blocks' counts, plus its number in the block: entries
are in the order of the files and gapless, and no file is sorted in one task.

A first scan finds each file's header, and files that aren't UTF-8 or close entries in another
way (a prefix, a space before >, an empty tag). Those, and all with whole_files, are parsed
whole, each by one task: by the encoding that its first bytes or XML declaration tell, and where
it isn't well formed, entry by entry like the others.
"""

from __future__ import annotations

import glob
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.expand import expand
from ..schema import as_units
from ..scratch import written

INLINE = frozenset("hi it ph ut bpt ept".split())
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
ENTRY = "tu_id string, notes array<string>, metadata map<string,string>, segments array<struct<lang:string,text:string>>, error string"
_XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_START = r"<(?:\w+:)?tu[\s>]"
#: Ends of entries other than </tu>.
_OTHER_END = r"</tu\s+>|</[\w.-]+:tu\s*>|<(?:[\w.-]+:)?tu(?:\s[^<>]*)?/>"
_ENTRY = r"<((?:[\w.-]+:)?tu)(?:\s[^<>]*)?(?:/>|(?<!/)>.*?(?:</\1\s*>|\Z)|\Z)"
_DECLARED = r"""^\s*<\?xml[^>]*?\sencoding\s*=\s*["']([\w.:-]+)"""
#: Starts of files in UTF-16 and UTF-32, in hexadecimal, with a mark or a first < or blank; the longer ones come first.
_WIDE = {"FFFE0000": "utf-32", "0000FEFF": "utf-32", "3C000000": "utf-32-le", "0000003C": "utf-32-be", "FFFE": "utf-16", "FEFF": "utf-16", "3C00": "utf-16-le", "003C": "utf-16-be", "0A00": "utf-16-le", "000A": "utf-16-be", "2000": "utf-16-le", "0020": "utf-16-be", "0D00": "utf-16-le", "000D": "utf-16-be"}
#: As a declaration in one of these can't be read as bytes, it is wrong where it can.
_WIDE_NAMES = "^(?:utf-?16|utf-?32|ucs-|iso-10646)"
_UTF8 = ("utf-8", "utf8", "us-ascii", "ascii")


def _name(element) -> str:
    """Local name; comments and instructions have none."""
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _named(element, name: str) -> list:
    return [x for x in element if _name(x) == name]


def segment_text(element, keep_tags: bool = False) -> str:
    """A segment's text: inline codes go with their content, or become {0}, {1}, ... with keep_tags; other tags only go."""
    count = 0

    def walk(e) -> str:
        nonlocal count
        parts = [e.text or ""]
        for child in e:
            if _name(child) in INLINE:
                if keep_tags:
                    parts.append("{%d}" % count)
                    count += 1
            elif _name(child):
                parts.append(walk(child))
            parts.append(child.tail or "")
        return "".join(parts).strip()

    return walk(element)


def entry(tu, header_lang: str | None, keep_tags: bool = False) -> tuple:
    """tu_id, notes, metadata and segments of one entry element."""
    notes = [x.text.strip() for x in _named(tu, "note") if x.text]
    metadata = {x.get("type", "unknown"): x.text or "" for x in _named(tu, "prop")}
    segments: dict[str, str] = {}
    for variant in _named(tu, "tuv"):
        lang = variant.get(_XML_LANG, variant.get("lang"))
        lang = lang.upper() if lang else None if segments else header_lang
        if not lang:
            continue
        for seg in _named(variant, "seg")[:1]:
            if text := segment_text(seg, keep_tags):
                segments[lang] = text
        for x in _named(variant, "prop"):
            kind = x.get("type")
            metadata["tuv_%s_prop" % lang if kind is None else kind] = x.text or ""
    return tu.get("tuid"), notes, metadata, list(segments.items())


def _prefixes(fragment: str) -> set[str]:
    """Names before a colon and a letter. Sought from the end: a search for colons is faster than one for beginnings of names."""
    back = fragment[::-1]
    found = re.finditer(r":([\w.-]*[A-Za-z_])[<\s/]", back)
    return {m.group(1)[::-1] for m in found if re.match("[A-Za-z_]", back[m.start() - 1 : m.start()])}


def _parse(fragment: str, header_lang: str | None, keep_tags: bool) -> tuple:
    prefixes = _prefixes(fragment) - {"xml", "xmlns"}
    declared = "".join(f' xmlns:{p}="urn:prefix:{p}"' for p in sorted(prefixes))
    try:
        return (*entry(ET.fromstring(f"<r{declared}>{fragment}</r>")[0], header_lang, keep_tags), None)
    except ET.ParseError as e:
        return None, [], {}, [], f"{e}: {fragment[:200]}"


def _decode(raw: bytes, errors: str = "replace") -> str:
    """A file's text by its byte order mark, first bytes or XML declaration, else UTF-8. An encoding that isn't known fails."""
    start = raw[:4].hex().upper()
    name = next((x for mark, x in _WIDE.items() if start.startswith(mark)), "")
    if not name:
        found = re.match(_DECLARED.encode(), raw[:1024])
        name = found.group(1).decode().lower() if found else "utf-8"
        if name in _UTF8 or re.match(_WIDE_NAMES, name):
            name = "utf-8-sig"
    return raw.decode(name, errors).removeprefix("\ufeff")


def _hadoop(path: str):
    """The Hadoop path and its file system."""
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(path: str) -> str | None:
    """The path on this machine, if it is one of plain characters: the JVM needn't be asked, which takes a call or more a file."""
    own = re.sub("^file:/+", "/", path)
    return own if re.fullmatch(r"[A-Za-z0-9_./=*-]+", own) else None


def _text(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files' entries as lines. Paths go to the JVM as one string."""
    if any("\n" in p for p in paths):
        return spark.read.option("lineSep", "</tu>").text(list(paths))
    names = spark._jvm.org.apache.commons.lang3.StringUtils.split("\n".join(paths), "\n")
    return DataFrame(spark._jsparkSession.read().option("lineSep", "</tu>").text(names), spark)


def discover(pattern: str, base: str = "") -> list[str]:
    """Paths for a pattern with * or ?, or the path itself if it is there; on any file system that Spark knows."""
    at = os.path.join(base, pattern)
    if "://" in at:
        if "\n" not in at and (own := _local(at)) and os.path.isabs(own):
            return [f"file://{x}" for x in sorted(glob.glob(own))]
        path, fs = _hadoop(at)
        return sorted(re.sub("^file:/+", "file:///", x.getPath().toString()) for x in fs.globStatus(path) or [])
    if "*" in pattern or "?" in pattern:
        return sorted(glob.glob(at, recursive=True))
    return [at] if os.path.exists(at) else []


def _paths(paths: str | Sequence[str]) -> list[str]:
    paths = [paths] if isinstance(paths, str) else [str(p) for p in paths]
    paths = [re.sub("^file:/+", "file:///", p) for p in paths]
    for p in paths:
        own = None if "*" in p else _local(p)
        if not (os.path.exists(own) if own else discover(p) if "://" in p else os.path.exists(p)):
            raise FileNotFoundError(p)
    out = []
    for p in paths:  # a folder stands for the files in it
        if "*" not in p and (own := _local(p)) and os.path.isfile(own):
            out.append(p)
            continue
        at, fs = _hadoop(p if "://" in p else os.path.abspath(p))
        folder = fs.getFileStatus(at).isDirectory() if "*" not in p and "?" not in p else False
        name = lambda x: x.toString() if "://" in p else x.toUri().getPath()  # noqa: B023, E731
        out += sorted(name(x.getPath()) for x in fs.listStatus(at) if x.isFile()) if folder else discover(p) if "://" in p else [p]
    return out


def _survey(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A row a file: file_index, path, file_id (as Spark names it), odd and head, the text before its first entry. One scan.

    A path given more than once has a row each time.
    """

    def uri(p: str) -> str:
        own = _local(p)
        if own and (p.startswith("file:") or plain):
            return f"file:{os.path.abspath(own)}"
        at, fs = _hadoop(os.path.abspath(p) if "://" not in p else p)
        return fs.makeQualified(at).toUri().toString()

    plain = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    files = spark.createDataFrame([(k, p, uri(p)) for k, p in enumerate(paths)], "file_index int, path string, uri string")
    text = _text(spark, sorted(set(paths))).select("value", F.monotonically_increasing_id().alias("mid"), F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"))
    start, encoding = F.hex(F.substring(F.col("value").cast("binary"), 1, 4)), F.lower(F.regexp_extract("value", _DECLARED, 1))
    first = F.col("block") == 0
    wide = start.rlike(f"^(?:{'|'.join(_WIDE)})") & F.col("value").contains("\0") | start.rlike("^(?:FFFE|FEFF)")
    named_other = (encoding != "") & ~encoding.isin(*_UTF8) & ~encoding.rlike(_WIDE_NAMES)
    odd = wide | named_other | F.col("value").rlike(_OTHER_END)
    head = F.min_by(F.when(first, F.regexp_replace(F.regexp_replace("value", f"(?s){_START}.*", ""), FORBIDDEN, "")), F.when(first, F.col("mid")))
    found = text.groupBy("file_id").agg(F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd"), head.alias("head"))
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    every = files.withColumn("key", key("uri")).join(found.withColumn("key", key("file_id")), "key", "left")
    return written(every.select("file_index", "path", F.coalesce("file_id", "uri").alias("file_id"), F.coalesce("odd", F.lit(False)).alias("odd"), "head"), "files")


def headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A row a file: file_index, source_lang, creation_tool, creation_date, seg_type, admin_lang, properties.

    A file without a header has nulls. Only what stands before a file's first entry is parsed, of a file that isn't UTF-8 after reading it whole.
    """
    return _headers(spark, _survey(spark, _paths(paths)))


def _headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    schema = "file_index int, source_lang string, creation_tool string, creation_date string, seg_type string, admin_lang string, properties map<string,string>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["file_index"], b["value"]):
                found = re.search(r"<((?:[\w.-]+:)?header)\b(?:[^>]*?/>|.*?</\1\s*>)", text or "", re.S)
                got = None
                if found:
                    inner = re.sub(r"(</?)[\w.-]+:", r"\1", found.group(0))
                    try:
                        got = ET.fromstring(re.sub(r'\sxmlns(:[\w.-]+)?="[^"]*"', "", inner))
                    except ET.ParseError:
                        pass
                lang = got.get("srclang") if got is not None else None
                get = (lambda a: got.get(a)) if got is not None else (lambda a: None)
                properties = {x.get("type", "unknown"): x.text or "" for x in _named(got, "prop")} if got is not None else {}
                rows.append((k, lang.upper() if lang else None, get("creationtool"), get("creationdate"), get("segtype"), get("adminlang"), properties))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    @F.pandas_udf("string")
    def before(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: re.split(_START, _decode(bytes(x)), maxsplit=1)[0])

    heads = files.where("not odd").select("file_index", F.col("head").alias("value"))
    odd = [x.path for x in files.where("odd").select("path").distinct().collect()]
    if odd:
        whole = spark.read.format("binaryFile").load(odd).select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace(before("content"), FORBIDDEN, "").alias("value"))
        heads = heads.unionByName(files.where("odd").select("file_index", "file_id").join(whole, "file_id", "left").select("file_index", "value"))
    return heads.mapInPandas(scan, schema)


def entries(spark: SparkSession, paths: str | Sequence[str], keep_tags: bool = False, whole_files: bool = False, strict: bool = False) -> DataFrame:
    """ordinal, file_id, header_lang, tu_id, notes, metadata, segments and error, in order of the files and of the entries in them.

    repaired counts the control characters taken out of an entry. strict: only entries in a body, and a broken file fails.
    """
    files = _survey(spark, _paths(paths))
    if whole_files or strict:
        files = files.withColumn("odd", F.lit(True))
    plain, odd = ([x.path for x in files.where(c).select("path").distinct().collect()] for c in ("not odd", "odd"))
    parts = [_chunks(spark, plain, _headers(spark, files.where("not odd")), files, keep_tags)] if plain else []
    parts += [_whole(spark, odd, keep_tags, strict)] if odd else []
    rows, blocks = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in zip(*parts))
    counts = blocks.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n")).join(files.select("file_index", "file_id"), "file_id")
    by = Window.orderBy("file_index", "block")  # a row a block of a file
    base = counts.select("file_index", "file_id", "block", (F.sum("n").over(by) - F.col("n")).alias("base"))
    ordinal = F.coalesce(F.col("base"), F.raise_error(F.lit("a file changed while it was read")).cast("long")) + F.col("rank")
    return rows.join(base, ["file_id", "block"], "left").select(ordinal.alias("ordinal"), *(c for c in rows.columns if c not in ("rank", "block")))


def _chunks(spark: SparkSession, paths: Sequence[str], header: DataFrame, files: DataFrame, keep_tags: bool) -> tuple[DataFrame, DataFrame]:
    """Entries with block and rank, their place in the block, by one narrow pass; and file_id and block of each, without parsing."""
    langs = {x.file_id: x.source_lang for x in header.join(files, "file_index").select("file_id", "source_lang").where("source_lang is not null").collect()}  # a row a file
    given = spark.sparkContext.broadcast(langs)
    text = _text(spark, paths)
    found = text.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.regexp_extract("value", f"(?s){_START}.*\\z", 0).alias("value")).where("value <> ''")
    clean = found.select("file_id", "block", F.regexp_count("value", F.lit(FORBIDDEN)).cast("int").alias("repaired"), F.concat(F.regexp_replace("value", FORBIDDEN, ""), F.lit("</tu>")).alias("value"))
    schema = f"file_id string, block long, rank long, header_lang string, repaired int, {ENTRY}"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n = None, 0  # a block's entries follow each other
        for b in batches:
            rows = []
            for name, block, repaired, value in b.itertuples(index=False, name=None):
                n = n + 1 if (name, block) == now else 0
                now = name, block
                lang = given.value.get(name)
                rows.append((name, block, n, lang, repaired, *_parse(value, lang, keep_tags)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return clean.mapInPandas(parse, schema), clean.select("file_id", "block")


def _whole(spark: SparkSession, paths: Sequence[str], keep_tags: bool, strict: bool) -> tuple[DataFrame, DataFrame]:
    schema = f"rank long, file_id string, header_lang string, repaired int, {ENTRY}"

    def events(text: str) -> Iterator[tuple]:
        parser = ET.XMLPullParser(("start", "end"), _parser=ET.XMLParser(encoding="utf-8"))
        raw = text.encode()
        for at in range(0, len(raw), 1 << 20):
            parser.feed(raw[at : at + (1 << 20)])
            yield from parser.read_events()
        parser.close()
        yield from parser.read_events()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                text = _decode(bytes(content), "strict" if strict else "replace")
                repaired = 0 if strict else len(re.findall(FORBIDDEN, text))
                text = text if strict else re.sub(FORBIDDEN, "", text)
                lang, rows, n, open_ = None, [], 0, []
                try:
                    for event, e in events(text):
                        if event == "start":
                            open_.append(_name(e))
                            continue
                        open_.pop()
                        if _name(e) == "header":
                            lang = (e.get("srclang") or "").upper() or None
                        elif _name(e) == "tu" and (not strict or open_[-1:] == ["body"]):
                            rows.append((n, name, lang, repaired if n == 0 else 0, *entry(e, lang, keep_tags), None))
                            n += 1
                            e.clear()
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                            rows = []
                except ET.ParseError:
                    if strict:
                        raise
                    for m in islice(re.finditer(_ENTRY, text, re.S), n, None):
                        rows.append((n, name, lang, repaired if n == 0 else 0, *_parse(m.group(0), lang, keep_tags)))
                        n += 1
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                            rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    content = spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("path"), "content")
    rows = written(content.mapInPandas(read, schema).withColumn("block", F.lit(0).cast("long")), "whole-files")
    return rows, rows.select("file_id", "block")


def read_tmx(spark: SparkSession, paths: str | Sequence[str], expand_multilingual: bool = False, **how) -> DataFrame:
    """Units of the files, in order. Entries that can't be parsed are left out; broken() counts them."""
    found = entries(spark, paths, **how).where("error is null").drop("error", "repaired")
    return as_units(expand(found, expand_multilingual))


def broken(spark: SparkSession, paths: str | Sequence[str], **how) -> DataFrame:
    """One row: entries, those that can't be parsed, and control characters taken out."""
    e = entries(spark, paths, **how)
    return e.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("error").isNotNull()).alias("broken"), F.coalesce(F.sum("repaired"), F.lit(0)).cast("long").alias("repaired"))
