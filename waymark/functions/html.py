"""HTML to text and structure as columns, plus the one Arrow helper that strips nested site furniture."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from waymark import signals

HEADING = r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"
TABLE = r"(?is)<table.*?</table>"


def text_of(html: Column) -> Column:
    """Tags out, block ends to newlines, entities decoded, blanks collapsed."""
    low, cut = F.lower(html), html
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        cut = F.regexp_replace(cut, pattern, " ")
    t = F.when(low.contains("<script") | low.contains("<style") | html.contains("<!--"), cut).otherwise(html)
    tagged = t
    for pattern, by in ((r"(?i)</(p|div|tr|li|h[1-6]|table|section)>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " ")):
        tagged = F.regexp_replace(tagged, pattern, by)
    # a heading or a cell mostly has no tag of its own
    t = F.when(html.contains("<"), tagged).otherwise(html)
    named = t
    for name, by in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        named = F.replace(named, F.lit(name), F.lit(by))
    t = named
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    decoded = F.aggregate(codes, t, lambda acc, d: F.replace(
        acc, F.concat(F.lit("&#"), d, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(F.pmod(d.cast("bigint"), F.lit(65536))), 4, "0")), "UTF-16BE")))
    # asked of the raw text: asking the cleaned one would clean it twice
    t = F.when(html.contains("#"), decoded).otherwise(t)
    # a single blank stays as it is
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\u00a0]{2,}|[\t\u00a0]", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def title_of(html: Column) -> Column:
    raw = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.substring(raw, 1, 200))


def headings_of(html: Column) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(HEADING), F.lit(2)), text_of)
    return F.slice(F.filter(found, lambda h: h != ""), 1, 40)


def sections_of(html: Column) -> Column:
    """Heading-scoped sections: the text before the first heading, then one per heading."""
    bodies = F.transform(F.split(html, HEADING, -1), text_of)
    heads = F.concat(F.array(F.lit("")), F.transform(F.regexp_extract_all(html, F.lit(HEADING), F.lit(2)), text_of))
    zipped = F.zip_with(heads, bodies, lambda h, b: F.named_struct(F.lit("heading"), h, F.lit("body"), b))
    return F.filter(zipped, lambda s: (s["heading"] != "") | (s["body"] != ""))


def tables_of(html: Column) -> Column:
    """Tables as arrays of rows of cell texts."""
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), text_of)
    return F.transform(F.regexp_extract_all(html, F.lit(TABLE), F.lit(0)), lambda t: F.transform(rows(t), cells))


# ---- nested furniture -----------------------------------------------------

_CHROME_ATTR = re.compile(
    r"(?:class|id)\s*=\s*[\"'](?:[^\"']*[\s_-])?(?:" + "|".join(signals.CHROME_WORDS) + r")(?:[\s_-]|[\"'])", re.I)


def _spans(html: str, tag: str):
    """(start, open_end, end or -1) of each element of one tag name; openers and closers pair up like brackets."""
    stack, found = [], []
    # a plain search is far cheaper; beyond ASCII other letters may fold into a tag's
    if html.isascii() and f"<{tag}" not in html.lower():
        return found
    for m in re.finditer(rf"<(/?){tag}\b[^>]*>", html, re.I):
        if m.group(1):
            if stack:
                found[stack.pop()][2] = m.end()
        elif not m.group(0).rstrip().endswith("/>"):
            stack.append(len(found))
            found.append([m.start(), m.end(), -1])
    return found


def _cut(html: str, spans) -> str:
    """Remove spans; an element that never closes loses only its opening tag."""
    out, at = [], 0
    for start, open_end, end in sorted(spans):
        if start < at:
            continue
        out.append(html[at:start])
        out.append(" ")
        at = open_end if end < 0 else end
    out.append(html[at:])
    return "".join(out)


def _main(html: str | None) -> tuple[str, bool]:
    if not html:
        return "", False
    for tag in signals.CHROME_TAGS:
        html = _cut(html, _spans(html, tag))
    marked = [s for tag in signals.CONTAINER_TAGS for s in _spans(html, tag) if _CHROME_ATTR.search(html[s[0]:s[1]])]
    html = _cut(html, marked)
    for tag in ("main", "article"):
        first = _spans(html, tag)[:1]
        if first and first[0][2] > 0:
            return html[first[0][0]:first[0][2]], True
    return html, False


#: Pages that are Python strings at once; the rest of a batch stays in Arrow's buffers.
PIECE = 64


@F.arrow_udf(T.StructType([T.StructField("html", T.StringType()), T.StructField("used_main", T.BooleanType())]))
def main_content(html: pa.Array) -> pa.Array:
    """Page narrowed to its content: nesting is not a regular language, so this runs in Arrow batches, a piece at a time."""
    kind = pa.struct([("html", pa.string()), ("used_main", pa.bool_())])
    pieces = []
    for at in range(0, len(html), PIECE):
        found = [_main(h) for h in html.slice(at, PIECE).to_pylist()]
        pieces.append(pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], fields=list(kind)))
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)
