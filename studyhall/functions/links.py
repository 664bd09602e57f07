"""Link helpers for content items (FN-21 .. FN-25) as built-in regex expressions.

Fixed values (must equal the reference's to classify the same links), in their order:
  video id patterns:  (?:youtube\\.com/watch\\?v=|youtu\\.be/|youtube\\.com/embed/)([^&\\n?#]+)
                      youtube\\.com/shorts/([^&\\n?#]+)
  file id patterns:   drive\\.google\\.com/file/d/([^/]+)
                      drive\\.google\\.com/open\\?id=([^&]+)
                      docs\\.google\\.com/.*/d/([^/]+)
  classes by type:    video -> youtube | unknown_video; pdf -> google_drive | direct_pdf;
                      link -> external_link; anything else -> unknown
  embed url:          https://drive.google.com/file/d/<id>/preview
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyhall.functions.exprs import as_col

# --- fixed values (see module docstring) ---
VIDEO_ID_PATTERNS = (
    r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([^&\n?#]+)",
    r"youtube\.com/shorts/([^&\n?#]+)",
)
FILE_ID_PATTERNS = (
    r"drive\.google\.com/file/d/([^/]+)",
    r"drive\.google\.com/open\?id=([^&]+)",
    r"docs\.google\.com/.*/d/([^/]+)",
)
EMBED_PREFIX = "https://drive.google.com/file/d/"
EMBED_SUFFIX = "/preview"


def _first_match(url: Column, patterns) -> Column:
    # regexp_extract gives '' when nothing matches; NULL-ify so coalesce tries the next pattern.
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


def video_id(url: Column | str) -> Column:
    """FN-21."""
    return _first_match(as_col(url), VIDEO_ID_PATTERNS)


def file_id(url: Column | str) -> Column:
    """FN-22."""
    return _first_match(as_col(url), FILE_ID_PATTERNS)


def url_class(url: Column | str, content_type: Column | str) -> Column:
    """FN-23: class of a link given the declared content type."""
    u, t = as_col(url), as_col(content_type)
    return (F.when(t == "video", F.when(video_id(u).isNotNull(), "youtube").otherwise("unknown_video"))
            .when(t == "pdf", F.when(file_id(u).isNotNull(), "google_drive").otherwise("direct_pdf"))
            .when(t == "link", F.lit("external_link"))
            .otherwise(F.lit("unknown")))


def embed_url(fid: Column) -> Column:
    """FN-24."""
    return F.concat(F.lit(EMBED_PREFIX), fid, F.lit(EMBED_SUFFIX))


def is_valid_url(url: Column | str) -> Column:
    """FN-25: the text parses as an absolute URL with a scheme."""
    u = as_col(url)
    return F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isNotNull() & u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"),
                      F.lit(False))
