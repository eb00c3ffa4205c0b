"""String, hash and JSON expressions over document text. Python's notion of white space is used throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.automaton import expanded_by_map

# White space, line breaks and the patterns of noise.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
HEADER_FOOTER = (r"(?U)第\s*\d+\s*页\s*共\s*\d+\s*页", r"(?Ui)page\s*\d+\s*of\s*\d+", r"(?U)^\s*\d{1,3}\s*$")
TOC = r"(?U)^\s*\d+(\.\d+)*\s+[一-鿿A-Za-z][^\n]{0,40}(?:[.·…]{2,}|\s+\.{2,}\s+)\s*\d{1,3}\s*$"
TOC_DOTS, TOC_END = "……", r"(?U)\d\s*$"
LANGUAGE = r"[一-鿿A-Za-z]"
GARBLED = r"[�\x00-\x08\x0e-\x1f]|Ã[\x80-\xbf]|â€[^\n]*"
LEAST_CHARS, GARBLED_LEAST = 10, 20
SAFE_ID = r"(?U)^[\w\-]{1,64}$"
SAFE_DEPARTMENT = r"(?U)^[\w一-鿿 \-]{1,64}$"
INTENTS = ("qa", "summary", "chat")
#: Words of a list up to which it is a native expression (which doubles with each); more are searched for by an automaton.
NATIVE_WORDS = 8


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def squeezed(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, rf"(?U){SPACE}+", "")


def stripped_lines(text: Column) -> Column:
    """Non-empty stripped lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def is_header_footer(line: Column) -> Column:
    first, *rest = HEADER_FOOTER
    found = line.rlike(first)
    for pattern in rest:
        found = found | line.rlike(pattern)
    return found


def is_toc(line: Column) -> Column:
    return line.rlike(TOC) | (line.contains(TOC_DOTS) & line.rlike(TOC_END))


def noise_reason(text: Column) -> Column:
    """too_short, header_footer, toc, no_language or null. Line patterns must hold for every line."""
    text = F.coalesce(text, F.lit(""))
    lines = stripped_lines(text)
    # all patterns of lines ask for a digit, which most texts don't have
    digits = text.rlike(r"(?U)\d")

    def reason(n: Column) -> Column:
        return (
            F.when(n == 0, "too_short")
            .when(digits & F.forall(lines, is_header_footer), "header_footer")
            .when(digits & F.forall(lines, is_toc), "toc")
            .when(~text.rlike(LANGUAGE), "no_language")
            .when(n < LEAST_CHARS, "too_short")
        )

    return F.transform(F.array(F.length(squeezed(text))), reason)[0]  # squeezed once


def is_garbled(text: Column) -> Column:
    """Worth a model's cleaning: long enough and with replacement, control or mojibake characters."""
    return F.coalesce((F.length(text) >= GARBLED_LEAST) & text.rlike(GARBLED), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha1(strip(text))


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    """The 31-bit id of a chunk; not unique at scale, so never a key."""
    return F.crc32(F.concat_ws(":", doc_id, chunk_index).cast("binary")).bitwiseAND(2147483647)


def path_key(path: Column) -> Column:
    return F.sha1(path)


def fingerprint(size: Column, modified: Column) -> Column:
    return F.sha1(F.concat_ws(":", size, modified))


def _dashed(name: Column, default: str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]", "-"), r"\A-+|-+\z", "")
    return F.when(plain == "", default).otherwise(plain)


def slices(x: pa.RecordBatch | pa.Array, rows: int = 256, size: int = 4_000_000) -> Iterator[pa.RecordBatch | pa.Array]:
    """Parts of a batch, in order, of at most so many rows and bytes (or one row), so that Python objects stand for a few rows at a time."""
    if len(x) > 1 and (len(x) > rows or x.nbytes > size):
        half = len(x) // 2
        yield from slices(x.slice(0, half), rows, size)
        yield from slices(x.slice(half), rows, size)
    elif len(x):
        yield x


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def doc_id_from_path(path: Column) -> Column:
    """parent-stem; over 64 characters, its first 52 and part of its hash."""
    base = F.concat_ws("-", _dashed(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1), "dir"), _dashed(stem(path), "doc"))
    return F.when(F.length(base) <= 64, base).otherwise(F.concat_ws("-", F.substring(base, 1, 52), F.substring(F.sha1(base), 1, 11)))


def slug(name: Column) -> Column:
    """A file's stem, letters, digits, - and _ only; at most 64 characters; `doc` if nothing is left."""
    plain = F.substring(F.regexp_replace(stem(name), r"[^\p{L}\p{N}_-]", ""), 1, 64)
    return F.when(plain == "", "doc").otherwise(plain)


def json_body(raw: Column) -> Column:
    """From the first { to the last }, else from [ to ], else all of it."""
    braces, brackets = F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return F.when(braces != "", braces).when(brackets != "", brackets).otherwise(raw)


def intent(raw: Column) -> Column:
    """The intent in a model's answer; anything unknown is qa."""
    found = F.get_json_object(json_body(raw), "$.intent")
    return F.when(found.isin(*INTENTS), found).otherwise("qa")


REFS = "array<struct<doc_id:string,section_path:string,score:double>>"


def parse_refs(refs: Column, schema: str = REFS) -> Column:
    """A JSON list, or an empty one on any error."""
    return F.coalesce(F.from_json(F.when(F.trim(refs).startswith("["), refs), schema), F.array().cast(schema))


def cut(text: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def safe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(SAFE_ID), F.lit(False))


def safe_department(value: Column) -> Column:
    return F.coalesce(value.rlike(SAFE_DEPARTMENT), F.lit(False))


def hash_embedding(text: Column, dim: int = 1024) -> Column:
    """A stand-in embedding: the bytes of SHA-256 over 255, repeated."""
    digest = F.sha2(text, 256)
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return F.slice(F.flatten(F.array_repeat(one, -(-dim // 32))), 1, dim)


def expand_terms(query: Column, terms: dict[str, str]) -> Column:
    """The query with the aliases it holds replaced, longest first, as a list of one; empty if nothing changes."""
    out, pairs = query, sorted(((a.strip(), s.strip()) for a, s in terms.items() if a and s), key=lambda x: -len(x[0]))
    if len(pairs) > NATIVE_WORDS:
        return expanded_by_map(query, pairs)
    for alias, standard in pairs:
        out = F.when(query.contains(alias), F.replace(out, F.lit(alias), F.lit(standard))).otherwise(out)
    return F.when((query != "") & (out != query), F.array(out)).otherwise(F.array().cast("array<string>"))


def merge_queries(queries: Column, variants: Column, most: int = 6) -> Column:
    """Queries, then variants, each once; cut to `most` only where there is a variant."""
    return F.when(F.size(variants) > 0, F.slice(F.array_distinct(F.concat(queries, variants)), 1, most)).otherwise(queries)


def bounded_expansion(base: Column, variants: Column, most: int = 3) -> Column:
    """The question and up to three non-blank variants."""
    good = F.filter(F.coalesce(variants, F.array().cast("array<string>")), lambda v: v.isNotNull() & (strip(v) != ""))
    return F.concat(F.array(base), F.slice(good, 1, most))
