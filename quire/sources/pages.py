"""PAGE-XML: regions, lines and texts in reading order.

A page is a tree whose group nesting has no bound, so it is walked by the standard parser inside Arrow batches; a page that cannot be read is a row with an
error. What fits patterns (ground-truth lines) is native.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import bbox, polygon
from quire.session import bounded_batches

REGIONS = "path string, region_id string, reading_order int, text string, last_text string, points string, error string"


@lru_cache(maxsize=1000)
def _bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _name(node: ET.Element) -> str:
    return _bare(node.tag)


def _kids(node: ET.Element, *names: str) -> list[ET.Element]:
    return [k for k in node if _name(k) in names]


def _ordered(group: ET.Element) -> Iterator[str]:
    """Region ids of a group: by index where one has it, those without behind; nested groups in place."""
    entries = []
    for kind in ("RegionRefIndexed", "RegionRef", "OrderedGroupIndexed", "UnorderedGroupIndexed", "OrderedGroup", "UnorderedGroup"):
        entries += [(int(k.get("index")) if k.get("index") is not None else None, k) for k in _kids(group, kind)]
    if any(i is not None for i, _ in entries):
        entries.sort(key=lambda e: (e[0] is None, e[0] or 0))
    for _, entry in entries:
        if _name(entry).startswith("RegionRef"):
            yield entry.get("regionRef")
        else:
            yield from _ordered(entry)


def reading_order(page: ET.Element) -> list[str]:
    """Ids of all text regions: those of the reading order first, the others in document order."""
    regions = [r.get("id") for r in page.iter() if _name(r) == "TextRegion"]
    groups = [g for order in _kids(page, "ReadingOrder") for g in _kids(order, "OrderedGroup", "UnorderedGroup")]
    named = list(_ordered(groups[0])) if groups else []
    known = set(named)
    return named + [r for r in regions if r not in known]


def page_rows(path: str, xml: str) -> list[dict]:
    """A row for each region with text; region_id and text null and an error where the page cannot be read."""
    try:
        page = next(iter(_kids(ET.fromstring(xml.encode("utf-8")), "Page")))
        regions = {r.get("id"): r for r in page.iter() if _name(r) == "TextRegion"}
        rows = []
        for region in (regions[i] for i in reading_order(page) if i in regions):
            texts = []
            for line in _kids(region, "TextLine"):
                equivs = _kids(line, "TextEquiv")
                first = next((u.text for u in _kids(equivs[0], "Unicode")), None) if equivs else None
                if first:
                    texts.append(first)
            own = [u.text for e in _kids(region, "TextEquiv") for u in _kids(e, "Unicode")]
            points = next((c.get("points") for c in _kids(region, "Coords")), None)
            if texts or own:
                rows.append({"path": path, "region_id": region.get("id"), "text": "\n".join(texts) or None, "last_text": own[-1] if own else None, "points": points, "error": None})
        order = 0
        for row in rows:
            row["reading_order"] = order if row["text"] is not None else None
            order += row["text"] is not None
        return rows
    except Exception as why:  # any page's fault is a row, not a failed job
        return [{"path": path, "region_id": None, "reading_order": None, "text": None, "last_text": None, "points": None, "error": f"{type(why).__name__}: {why}"}]


def regions(pages: DataFrame) -> DataFrame:
    """Rows of REGIONS from rows (path, text) of PAGE-XML files; reading_order counts the regions with line texts."""
    kinds = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (f.split() for f in REGIONS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, x in zip(*(c.to_pylist() for c in batch.columns)) for r in page_rows(p, x)]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    bounded_batches(pages.sparkSession)
    return pages.select("path", "text").mapInArrow(run, REGIONS)


def text_regions(pages: DataFrame) -> DataFrame:
    """Rows (path, region_id, reading_order, text, error) of regions whose lines have text."""
    return regions(pages).where("text IS NOT NULL OR error IS NOT NULL").select("path", "region_id", "reading_order", "text", "error")


def boxed_regions(pages: DataFrame, longer_than: int = 20) -> DataFrame:
    """Rows (path, region_id, text, min_x, max_x, min_y, max_y) by the region's own last text; "No text" without one. Short texts go."""
    out = regions(pages).where("error IS NULL").withColumn("text", F.coalesce("last_text", F.lit("No text"))).withColumn("box", bbox(polygon(F.col("points"))))
    return out.where(F.length("text") > longer_than).select("path", "region_id", "text", "box.*")


def ground_truth(xml: Column, first: int = 4) -> Column:
    """The first Unicode texts of a file, joined by two spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(xml, F.lit(r"<Unicode>([^<]*)</Unicode>"), F.lit(1)), 1, first), "  ")


def page_xml(image: Column, width: Column, height: Column, lines: Column) -> Column:
    """A PAGE-XML text of one region; lines: array<struct<id, points, baseline, text>>."""
    escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.transform(
        lines,
        lambda n: F.format_string(
            '<TextLine id="%s"><Coords points="%s"/><Baseline points="%s"/><TextEquiv><Unicode>%s</Unicode></TextEquiv></TextLine>', n["id"], n["points"], n["baseline"], escape(n["text"])
        ),
    )
    return F.format_string(
        '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="%s" imageWidth="%d" imageHeight="%d">'
        '<TextRegion id="r1"><Coords points="0,0 %d,0 %d,%d 0,%d"/>%s</TextRegion></Page></PcGts>',
        image, width, height, width, width, height, height, F.array_join(line, ""),
    )


def with_image_urls(xml: Column, url: Column) -> Column:
    """The page with its image file name replaced by a URL."""
    return F.when(url.isNull(), xml).otherwise(F.regexp_replace(xml, F.lit(r'imageFilename="[^"]*"'), F.concat(F.lit('imageFilename="'), F.replace(url, F.lit("$"), F.lit("\\$")), F.lit('"'))))


#: A page between its lines: before each line's tag, and behind each line's end. What may end one is looked at first: to look back by all lengths at each character is most of the work.
_BESIDE_LINES = r"(?=<(?:\w{1,20}:)?TextLine[\s>/])|(?<=TextLine>)(?:(?<=</TextLine>)|(?<=</\w{1,20}:TextLine>))"
#: Words keep their texts; what is the line's own goes.
_OWN_TEXTS = r"(?s)(<(\w+:)?Word[\s>].*?</(?:\w+:)?Word>)|<(?:\w+:)?TextEquiv(?:\s[^>]*)?(?:/>|(?<!/)>.*?</(?:\w+:)?TextEquiv>)"
_LINE_HEAD = r"^<(\w+:)?TextLine(?:\s[^>]*?)?(/?)>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def with_line_texts(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """The pages (path, text) with new texts of lines in place: rows (path, line_id, text, conf or none) of ``texts``.

    A line that is named loses the texts it had and gets the new one, unless that is null or empty; other lines, and all else of a page, stay byte for byte. The page is cut at
    its lines, the lines looked up in the page's own new texts, and joined again: no page is parsed, one join brings the texts. Of several texts for one line the greatest counts.
    """
    said = texts if "conf" in texts.columns else texts.withColumn("conf", F.lit(None).cast("double"))
    one = said.where("line_id IS NOT NULL").groupBy("path", "line_id").agg(F.max(F.struct("text", "conf")).alias("new"))
    of_page = one.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line_id", "new"))).alias("__new"))  # as many as the page has lines

    def with_(name: str, value: Callable[[Column], Column], fields: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda x: F.struct(*(x[f].alias(f) for f in fields), value(x).alias(name))

    def edited(x: Column) -> Column:
        conf = F.when(x["new"]["conf"].isNotNull(), F.concat(F.lit(' conf="'), x["new"]["conf"].cast("string"), F.lit('"'))).otherwise("")
        equiv = F.concat(F.lit("<"), x["prefix"], F.lit("TextEquiv"), conf, F.lit("><"), x["prefix"], F.lit("Unicode>"), _escaped(x["new"]["text"]), F.lit("</"), x["prefix"], F.lit("Unicode></"), x["prefix"], F.lit("TextEquiv>"))
        added = F.when(F.coalesce(x["new"]["text"], F.lit("")) != "", equiv).otherwise("")
        # Its place is behind the words, before what describes the line.
        full = F.concat(F.left(x["bare"], F.length(x["bare"]) - F.length(x["behind"])), added, x["behind"])
        closed = F.endswith(x["head"], F.lit("/>"))
        opened = F.concat(F.left(x["head"], F.length(x["head"]) - 2), F.lit(">"), added, F.lit("</"), x["prefix"], F.lit("TextLine>"), F.substr(x["piece"], F.length(x["head"]) + 1))
        return F.when(x["new"].isNull(), x["piece"]).when(closed & (F.coalesce(x["new"]["text"], F.lit("")) == ""), x["piece"]).when(closed, opened).otherwise(full)

    # Each step finds one thing of a piece, so every pattern runs once, and but the first only on lines.
    steps = {
        "head": lambda x: F.regexp_extract(x["piece"], _LINE_HEAD, 0),
        "new": lambda x: F.when(x["head"] != "", F.element_at(F.col("__new"), F.regexp_extract(x["head"], r"\sid=[\"']([^\"']*)[\"']", 1))),
        "prefix": lambda x: F.when(x["new"].isNotNull(), F.regexp_extract(x["head"], _LINE_HEAD, 1)),
        "bare": lambda x: F.when(x["new"].isNotNull() & ~F.endswith(x["head"], F.lit("/>")), F.regexp_replace(x["piece"], _OWN_TEXTS, "$1")),
        "behind": lambda x: F.regexp_extract(x["bare"], r"(?s)((?:<(?:\w+:)?(?:TextStyle|UserDefined|Labels)[\s>/].*)?</(?:\w+:)?TextLine>)$", 1),
    }
    pieces, fields = F.transform(F.split("text", _BESIDE_LINES), lambda p: F.struct(p.alias("piece"))), ("piece",)
    for name, value in steps.items():
        pieces, fields = F.transform(pieces, with_(name, value, fields)), (*fields, name)

    joined = pages.join(of_page, "path", "left")
    return joined.withColumn("text", F.when(F.col("__new").isNotNull(), F.array_join(F.transform(pieces, edited), "")).otherwise(F.col("text"))).drop("__new")
