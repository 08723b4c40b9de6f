"""Text and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, CLOSE = "\u0001", "\u0002"
#: The instructions that the meaning model expects before queries and documents.
QUERY_PROMPT, DOCUMENT_PROMPT = "task: search result | query: ", "title: none | text: "
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff")


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as file paths and short terms are compared."""
    return F.translate(c, UPPER, LOWER)


def clean_text(c: Column) -> Column:
    """Runs of space, tab and line ends become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \\n\\r\\t]+", " "))


def collapse(c: Column) -> Column:
    """All white space collapsed, lower case: what the image model's text encoder reads."""
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def doc_prompt(c: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_PROMPT), clean_text(c))


def query_prompt(c: Column) -> Column:
    return F.concat(F.lit(QUERY_PROMPT), clean_text(c))


def line_ends(c: Column) -> Column:
    """Every kind of line end becomes one space."""
    return F.regexp_replace(c, "\\r\\n|[\\r\\n\\f\\u0085\\u2028\\u2029]", " ")


def clean_snippet(c: Column) -> Column:
    """Without highlight markers and line ends."""
    return F.trim(line_ends(F.translate(c, OPEN + CLOSE, "")))


def clip(c: Column, most: int, keep: int, tail: str) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep), F.lit(tail))).otherwise(c)


def clip_title(c: Column) -> Column:
    return clip(c, 60, 57, "…")


def file_stem(path: Column) -> Column:
    """The last path element without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*)$", 1), "\\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def has_extension(path: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def under(path: Column, folder: str, sep: str = "/") -> Column:
    """The path itself or anything below it; letters A-Z in either case."""
    return (ascii_lower(path) == folder.translate(str.maketrans(UPPER, LOWER))) | ascii_lower(path).startswith((folder + sep).translate(str.maketrans(UPPER, LOWER)))


def re_prefix(path: Column, old: str, new: str) -> Column:
    return F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))


def source_slug(c: Column) -> Column:
    """A source's name from a folder's: letters and digits, the rest as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{Nd}]+", "-"), "^-+|-+$", "")


def thumb_key(path: Column, size: Column, mtime: Column) -> Column:
    """Key of a cached thumbnail: it changes with path, size or time."""
    return F.upper(F.sha1(F.concat_ws("|", F.lower(path), size.cast("string"), mtime.cast("string"))))


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n", -1))


def has_border(needle: str) -> bool:
    """Whether the needle can overlap itself."""
    return any(needle[:i] == needle[-i:] for i in range(1, len(needle)))


def occurrences(haystack: Column, needle: str) -> Column:
    """How often the needle stands in the text, overlaps included."""
    if has_border(needle):
        quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.regexp_count(haystack, F.lit(f"(?={quoted})"))
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def like_short(c: Column, term: str) -> Column:
    """``%term%`` with live wildcards, A-Z folded; the backslash is an ordinary character."""
    return ascii_lower(c).like("%" + term.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def contains_long(text: Column, term: str) -> Column:
    """A long term anywhere, case folded.  Fewer than three code points (surrogate pairs) match nothing."""
    return F.contains(F.lower(text), F.lit(term.lower())) if len(term) >= 3 else F.lit(False)


def snippet(text: Column, term: str | None, width: int = 66, plain: int = 160) -> Column:
    """A window of ``width`` characters around the first match, marked, with an ellipsis at each cut side.

    Without a match, or a term, the text's first ``plain`` characters.  Where the window lies is a matter of display: the match
    stands in its middle unless the text's ends are near.
    """
    start = F.substring(text, 1, plain)
    if not term:
        return start
    low = F.lower(text)
    at = F.locate(term.lower(), low)
    n = len(term)
    begin = F.greatest(F.lit(1), F.least(at - (width - n) // 2, F.length(text) - width + 1))
    cut = F.substr(text, begin, F.lit(width))
    inside = at - begin + 1
    marked = F.concat(F.substr(cut, F.lit(1), inside - 1), F.lit(OPEN), F.substr(cut, inside, F.lit(n)), F.lit(CLOSE), F.substr(cut, inside + n))
    out = F.concat(F.when(begin > 1, "…").otherwise(""), marked, F.when(begin + width - 1 < F.length(text), "…").otherwise(""))
    return F.when((at > 0) & (F.length(low) == F.length(text)), out).otherwise(start)
