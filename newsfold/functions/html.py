"""Functions on fetched pages and site maps (string columns)."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.functions.text import bound, contains_any, strip


def clean_html(text: Column) -> Column:
    """Delete tags and lower-case entities. A tag may not run over a newline."""
    return F.regexp_replace(text, "(?d)" + V.MARKUP_PATTERN, "")


def extract_title(html: Column) -> Column:
    """Text of the document title; null where there is no title element or it is empty."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(raw != "", strip(clean_html(raw)))


def _balanced_parts(html: Column, element: str) -> Column:
    """Pieces of a page between the tags of one element: struct of ``text``, ``depth`` (of elements that the piece is
    inside of), ``outer`` (number of the outermost one) and ``inner`` (number of the innermost one), both counted from 1.

    A closing tag without an opening one is skipped; elements that are never closed end with the page.
    """
    pieces = F.split(F.regexp_replace(html, rf"(?i)</{element}\s*>", f"</{element}>"), rf"(?i)(?=<{element}[\s>])|(?=</{element}>)")
    start = F.struct(
        F.array().cast("array<int>").alias("open"),
        F.lit(0).alias("outer"),
        F.lit(0).alias("seen"),
        F.array().cast("array<struct<text:string,depth:int,outer:int,inner:int>>").alias("parts"),
    )

    def step(state: Column, piece: Column) -> Column:
        opens = piece.rlike(rf"(?i)\A<{element}[\s>]")
        closes = piece.rlike(rf"(?i)\A</{element}>") & (F.size(state["open"]) > 0)
        seen = state["seen"] + opens.cast("int")
        outer = state["outer"] + (opens & (F.size(state["open"]) == 0)).cast("int")
        now = F.when(opens, F.array_append(state["open"], seen)).when(closes, F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)).otherwise(state["open"])

        def kept(now: Column) -> Column:
            part = F.struct(piece.alias("text"), F.size(now).alias("depth"), outer.alias("outer"), F.coalesce(F.get(now, F.size(now) - 1), F.lit(0)).alias("inner"))
            return F.struct(now.alias("open"), outer.alias("outer"), seen.alias("seen"), F.array_append(state["parts"], part).alias("parts"))

        return bound(now, kept)

    return F.aggregate(pieces, start, step, lambda state: state["parts"])


def _longest(parts: Column, number: str) -> Column:
    """The cleaned text of the element (by its number) that has most of it; the first of equal ones; null without any text."""
    inside = F.filter(parts, lambda p: p["depth"] > 0)

    def texts(inside: Column) -> Column:
        numbers = F.array_distinct(F.transform(inside, lambda p: p[number]))
        return F.transform(numbers, lambda k: strip(clean_html(F.array_join(F.transform(F.filter(inside, lambda p: p[number] == k), lambda p: p["text"]), ""))))

    def best(texts: Column) -> Column:
        most = F.array_max(F.transform(texts, F.length))
        return F.get(F.filter(texts, lambda t: (F.length(t) == most) & (most > 0)), F.lit(0))

    return bound(bound(inside, texts), best)


def extract_body(html: Column) -> Column:
    """The text of an article page, without comments, scripts and styles.

    Of several articles, that with most text is taken, whole: articles inside it belong to it. Without a non-empty article,
    it is the text of all paragraphs; one that is not closed ends where the next begins or its block ends. Without
    paragraphs, it is the text of the division that has most text of its own, outside of divisions within it. Null if there
    is none of these.
    """

    def visible_text(page: Column) -> Column:
        paragraphs = F.filter(
            F.transform(F.regexp_extract_all(page, F.lit(V.PARAGRAPH), F.lit(1)), lambda p: strip(clean_html(p))), lambda p: p != ""
        )
        article = F.when(page.rlike(r"(?i)<article[\s>]"), _longest(_balanced_parts(page, "article"), "outer"))
        division = F.when(page.rlike(r"(?i)<div[\s>]"), _longest(_balanced_parts(page, "div"), "inner"))
        return F.coalesce(article, F.nullif(strip(F.array_join(paragraphs, "\n")), F.lit("")), division)

    visible = html
    for hidden in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
        visible = F.regexp_replace(visible, hidden, "")
    return bound(visible, visible_text)


def trim_media_credit(text: Column, words: Sequence[str] = V.MEDIA_CREDIT_WORDS) -> Column:
    """Where a credit word occurs in a text of several lines, keep the second line only."""
    has_word = contains_any(text, words)
    second_line = strip(F.split_part(text, F.lit("\n"), F.lit(2)))
    return F.when(has_word & F.contains(text, F.lit("\n")), second_line).otherwise(text)


def _locations(xml: Column, element: str) -> Column:
    """All ``<loc>`` texts inside the named elements of a site map."""
    blocks = F.regexp_extract_all(xml, F.lit(rf"(?s)<{element}(?:\s[^>]*)?>(.*?)</{element}>"), F.lit(1))
    found = F.flatten(
        F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc>"), F.lit(1)))
    )

    def unescape(link):
        link = F.regexp_replace(link, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            link = F.replace(link, F.lit(entity), F.lit(mark))
        return link

    return F.transform(found, unescape)


def sitemap_locations(xml: Column) -> Column:
    """Links of a site-map index."""
    return _locations(xml, "sitemap")


def article_locations(xml: Column) -> Column:
    """Links of a site map."""
    return _locations(xml, "url")


def guess_publish_date(url: Column, html: Column) -> Column:
    """Struct of date, method and accuracy; the most accurate finding wins.

    Order: a page tag with a time ("datetime"), a full date in the URL ("date"),
    a page tag with a date only ("date"), year and month in the URL ("partial",
    set to the first of the month). Dates that do not exist are skipped.
    """
    name_first = r"""(?is)<(?:meta[^>]*published_time["'][^>]*content|time[^>]*datetime)\s*=\s*["']([^"']*)["']"""
    value_first = r"""(?is)<meta[^>]*content\s*=\s*["']([^"']*)["'][^>]*published_time["']"""
    stamp = F.coalesce(
        *[F.nullif(F.regexp_extract(html, tag, 1), F.lit("")) for tag in (name_first, value_first)]
    )

    def parsed(found: Column, pattern: str, layout: str) -> Column:
        text = F.regexp_extract(found, pattern, 1)
        return F.when(text != "", F.try_to_timestamp(text, F.lit(layout)))

    clock = parsed(F.replace(stamp, F.lit("T"), F.lit(" ")), r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", "yyyy-MM-dd HH:mm:ss")
    tag_day = parsed(stamp, r"^(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd")
    url_day = parsed(url, r"/(\d{4}/\d{2}/\d{2})/", "yyyy/MM/dd")
    url_month = parsed(url, r"/(\d{4}/\d{2})/", "yyyy/MM")
    findings = (
        (clock, "page tag", "datetime"),
        (url_day, "url", "date"),
        (tag_day, "page tag", "date"),
        (url_month, "url", "partial"),
    )
    return F.coalesce(
        *[
            F.when(
                value.isNotNull(),
                F.struct(
                    value.alias("publish_date"),
                    F.lit(method).alias("published_method_found"),
                    F.lit(accuracy).alias("published_guess_accuracy"),
                ),
            )
            for value, method, accuracy in findings
        ]
    )
