"""Text expressions, all as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of blocks at the very start; each ends at the first closing tag.
_BLOCKS = r"(?s)^\s*((?:<think>.*?</think>\s*)+)"
_ONE_BLOCK = r"(?s)<think>(.*?)</think>"


def strip_blanks(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def thinking(text: Column) -> Column:
    """struct(text, reasoning): leading ``<think>`` blocks cut off and joined by an empty line.

    Blocks behind other text, and unclosed ones, stay. Without a block reasoning is null and the
    text unchanged; an empty block gives an empty reasoning.
    """
    head = F.regexp_extract(text, _BLOCKS, 0)
    found = F.length(head) > 0
    parts = F.transform(F.regexp_extract_all(head, F.lit(_ONE_BLOCK), F.lit(1)), strip_blanks)
    return F.struct(
        F.when(found, F.substr(text, F.length(head) + 1)).otherwise(text).alias("text"),
        F.when(found, F.array_join(parts, "\n\n")).alias("reasoning"),
    )


def data_url(content: Column, mime: Column) -> Column:
    """Binary content as a data URL."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def guess_mime(path: Column) -> Column:
    """MIME type of an image by the end of its path; null if unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in _MIME.items() for x in kv]), ending)


def image_block(url: Column, detail: Column | None = None) -> Column:
    """struct(type, image_url) for a http(s) or data URL; raises on others."""
    fine = url.rlike(r"^(?i:https?://|data:image/)")
    checked = F.when(fine, url).otherwise(
        F.raise_error(F.concat(F.lit("image URLs must be http, https or data: "), F.coalesce(url, F.lit("null"))))
    )
    return F.struct(
        F.lit("image_url").alias("type"),
        F.struct(checked.alias("url"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail")).alias("image_url"),
    )


def insecure_base(url: Column) -> Column:
    """Whether a base URL is plain http to a host that isn't this machine."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.lower(url).startswith("http://") & ~host.isin("localhost", "127.0.0.1", "::1", "[::1]", "0.0.0.0")
