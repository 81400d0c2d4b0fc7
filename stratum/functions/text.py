"""Column functions over text, identifiers, markers, citations and JSON replies. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval leaves out, and Russian endings, longest first.
STOPWORDS = "как для или при что это были была было быть какие какой какая где когда после перед между через отчёт отчет отчёте отчете работ работы страница страницы".split()
ENDINGS = "иями ями ами его ого ему ому ыми ими ую юю ая яя ое ее ие ые ой ей ам ям ах ях ов ев ом ем ы и а я у ю е".split()
#: Page markers, citations, and tokens that OCR garbles.
MARKER_LEGACY, MARKER_CURRENT = r"\[SOURCE_PAGE:\s*page_(\d{5})\.[^\]]+\]", r"\[SOURCE_PAGE:\s*page:(\d{5})(?:;[^\]]*)?\]"
MARKER = rf"{MARKER_LEGACY}|{MARKER_CURRENT}"
SOURCE = r"(?iu)\[SOURCE_PAGE:\s*([^;\]\s]+)"
CITATION = r"(?iu)\[стр\.\s*([\d\s,;–—-]+)\]"
GLYPHS, JOINTS = "0-9ІIОоOoТт", ".,:/-"
#: From the start of a run of such characters to its last digit, and on to the end of that digit's token. Each run is read once,
#: and the possessive group needs no stack, so texts of any length will do.
NUMERIC_RUN = rf"(?<![{GLYPHS}{JOINTS}])[{GLYPHS}{JOINTS}]*\d(?:[{JOINTS}]?[{GLYPHS}])*+"
LABEL = r"^-[0-9]+(?:\.[0-9]{1,3})?$"
#: Letters of search tokens that have another case or form.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁё"


def lit_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(c: Column | str) -> Column:
    """Lower case with ё as е."""
    return F.translate(F.lower(lit_col(c)), "ё", "е")


def numeric_ocr(c: Column | str) -> Column:
    """Digits for the letters that OCR takes for them, in tokens of a run of letters and joints before which or in which a digit stands."""
    c = lit_col(c)
    between, hits = F.split(c, NUMERIC_RUN, -1), F.regexp_extract_all(c, F.lit(NUMERIC_RUN), F.lit(0))
    fixed = F.transform(hits, lambda t: F.translate(t, "ІIОоOoТт", "11000011"))
    return F.array_join(F.zip_with(between, fixed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def slug(c: Column | str) -> Column:
    """Letters and digits in lower case, all else as single hyphens; "unnamed" when nothing is left."""
    bare = F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unnamed"))


def entity_id(kind: Column | str, name: Column | str) -> Column:
    return F.concat(lit_col(kind), F.lit(":"), slug(name))


def canonical_name(c: Column | str) -> Column:
    """A name without its generic words, for alias checks."""
    bare = fold(c)
    for word in ("структура", "площадь", "скважина"):
        bare = F.replace(bare, F.lit(word), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def entity_name(kind: Column | str, index: Column | str, names: list[Column], statement: Column) -> Column:
    """The first non-blank name, else the start of the statement, else kind and number."""
    blank = [F.nullif(F.trim(n), F.lit("")) for n in names]
    return F.coalesce(*blank, F.nullif(F.substring(F.trim(statement), 1, 90), F.lit("")), F.concat(lit_col(kind), F.lit("-"), (lit_col(index) + 1).cast("string")))


def marker(page: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("[SOURCE_PAGE: "), lit_col(page), F.lit("; path="), lit_col(path), F.lit("]"))


def source_refs(c: Column | str) -> Column:
    """Page references of all markers in order."""
    return F.regexp_extract_all(lit_col(c), F.lit(SOURCE), F.lit(1))


def page_ids(c: Column | str) -> Column:
    """Distinct pages of old and current markers as text:00012, in order."""
    c = lit_col(c)
    numbers = F.array_union(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (MARKER_LEGACY, MARKER_CURRENT)))
    return F.transform(F.array_sort(numbers), lambda n: F.concat(F.lit("text:"), n))


def cited_pages(c: Column | str) -> Column:
    """Distinct page numbers inside citations; of a range its ends."""
    inside = F.regexp_extract_all(lit_col(c), F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(inside, lambda s: F.regexp_extract_all(s, F.lit(r"(\d{1,5})"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def tokens(c: Column | str) -> Column:
    """Search tokens: runs of two or more letters, digits and hyphens without stop words, Russian endings cut."""
    folded = F.translate(lit_col(c), UPPER, UPPER.lower().replace("ё", "е"))  # these letters alone, as others are no part of a token
    raw = F.regexp_extract_all(folded, F.lit(r"([0-9a-zа-я-]{2,})"), F.lit(1))
    kept = F.filter(raw, lambda t: ~t.isin(*[w.replace("ё", "е") for w in STOPWORDS]))
    return F.transform(kept, lambda t: F.regexp_replace(t, rf"^(?=[а-я-]+$)(.{{4,}}?)(?:{'|'.join(ENDINGS)})$", "$1"))


def keyword_score(c: Column | str, words: list[str]) -> Column:
    """Occurrences of all keywords, case folded."""
    low = F.lower(lit_col(c))
    return sum((F.regexp_count(low, F.lit(rf"\Q{w.lower()}\E")) for w in words), F.lit(0))


def unfence(c: Column | str) -> Column:
    """A reply without its code fence."""
    return F.regexp_replace(F.trim(lit_col(c)), r"(?i)^```(?:json)?\s*|\s*```$", "")


def json_object(c: Column | str) -> Column:
    """VARIANT of a reply: the whole of it, else its first braces to its last; null when neither parses to an object."""
    bare = unfence(c)
    inner = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    value = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def excerpt(c: Column | str, n: int = 500) -> Column:
    return F.rtrim(F.left(F.replace(lit_col(c), F.lit("\n"), F.lit(" ")), F.lit(n)))


def truncate(c: Column | str, n: int) -> Column:
    """At most n characters, the last of them an ellipsis when something was cut."""
    c = lit_col(c)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…")))


def safe_name(c: Column | str) -> Column:
    """A file name of letters, digits, dot, hyphen and underscore."""
    return F.regexp_replace(F.regexp_extract(lit_col(c), r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._-]+", "_")


def natural_key(c: Column | str) -> Column:
    """A string whose order is the natural one: numbers of any length by value, letters case folded."""
    parts = F.regexp_extract_all(F.lower(lit_col(c)), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.char_length(bare(p)).cast("string"), 10, "0"), bare(p))).otherwise(p)), "")


def last_number(path: Column | str) -> Column:
    """The last run of digits in a file's stem."""
    stem = F.regexp_replace(F.regexp_extract(lit_col(path), r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.get(F.reverse(F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1))), F.lit(0)).try_cast("int")


def content_key(c: Column | str, n: int = 64) -> Column:
    return F.left(F.sha2(lit_col(c), 256), F.lit(n))


def media_type(path: Column | str) -> Column:
    """Media types by suffix."""
    suffix = F.lower(F.regexp_extract(lit_col(path), r"\.([^./]+)$", 1))
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "json": "application/json", "geojson": "application/geo+json", "html": "text/html", "txt": "text/plain", "xyz": "text/plain"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv)), suffix), F.lit("application/octet-stream"))


def label_value(c: Column | str, interval: float, tolerance: float) -> Column:
    """A depth label in km snapped to the contour interval; null when it isn't a label or lies too far from a level."""
    text = F.translate(F.trim(lit_col(c)), ",−–", ".--")
    value = F.when(text.rlike(LABEL), text.cast("double"))
    value = F.when((F.abs(value) >= 100) & F.lit(interval < 10), value / 1000).otherwise(value)
    snapped = F.rint(value / F.lit(interval)) * F.lit(interval)
    return F.when(F.abs(value - snapped) <= tolerance, F.bround(snapped, 3))
