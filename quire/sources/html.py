"""Pages: normalised text with source offsets and table ranges, inline facts, headings."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from quire.session import map_in_frames

BLOCKS = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul body".split())
SKIPPED = frozenset("script style head noscript template svg ix:header ix:hidden".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAST_FRAME = 200


def _hidden(attrs: dict[str, str | None]) -> bool:
    style = (attrs.get("style") or "").lower().replace(" ", "")
    return "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class _Normaliser(HTMLParser):
    """One string of a page's visible text: blocks parted by a blank line, ``br`` a line end, white space one blank."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.size, self.segments, self.tables = 0, [], []
        self.pending, self.stack, self.skip, self.table_depth, self.table_start = "", [], 0, 0, 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _break(self, mark: str) -> None:
        if len(mark) > len(self.pending) or self.pending == " ":
            self.pending = mark

    def _text(self, raw: str, at: int, width: int) -> None:
        if self.skip:
            return
        words = raw.replace(" ", " ").split()
        if raw[:1].isspace() and not self.pending:
            self.pending = " "
        if not words:
            return
        lead = self.pending if self.out else ""
        self.pending = " " if raw[-1:].isspace() else ""
        body = " ".join(words)
        self.segments.append((at, width, self.size + len(lead), len(body)))
        self.out += [lead, body]
        self.size += len(lead) + len(body)

    def handle_data(self, data):
        self._text(data, self._at(), len(data))

    def handle_entityref(self, name):
        self._text(unescape(f"&{name};"), self._at(), len(name) + 2)

    def handle_charref(self, name):
        self._text(unescape(f"&#{name};"), self._at(), len(name) + 3)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._break("\n")
        if tag in BLOCKS:
            self._break("\n\n")
        if tag in VOID:
            return
        off = tag in SKIPPED or _hidden(dict(attrs))
        self.stack.append((tag, off))
        self.skip += off
        if tag == "table" and not self.skip:
            self.table_depth += 1
            if self.table_depth == 1:
                self.table_start = self.size

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._break("\n\n")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for name, off in self.stack[i:]:
                    self.skip -= off
                    if name == "table" and self.table_depth:
                        self.table_depth -= 1
                        if not self.table_depth and self.size > self.table_start:
                            lead = 2 if self.table_start else 0
                            self.tables.append((min(self.table_start + lead, self.size), self.size))
                del self.stack[i:]
                return


def normalise(html: str | None) -> dict:
    """Text, segments (source place and width, text place and width) and outermost table ranges of a page."""
    n = _Normaliser(html or "")
    return {"text": "".join(n.out), "segments": n.segments, "tables": n.tables}


def normalised(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """(keys, text, segments, tables) of each page."""

    def run(frames):
        for f in frames:
            rows = [normalise(h) for h in f[html]]
            out = f[list(keys)].reset_index(drop=True)
            out["text"] = [r["text"] for r in rows]
            out["segments"] = [[dict(zip(("source", "width", "start", "size"), s, strict=True)) for s in r["segments"]] for r in rows]
            out["tables"] = [[{"s": s, "e": e} for s, e in r["tables"]] for r in rows]
            yield out

    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_in_frames(pages.select(*keys, html), run, f"{fields}, text string, segments array<struct<source:int,width:int,start:int,size:int>>, tables array<struct<s:int,e:int>>")


_NAME = r"[A-Za-z][A-Za-z0-9:_.-]*"
#: Text up to a plain tag: its attributes have quoted values.
PLAIN_TAG = re.compile(rf"""([^<]*)<(/?)({_NAME})((?:[ \t\n\r\f]+{_NAME}=(?:"[^"]*"|'[^']*'))*)[ \t\n\r\f]*(/?)>""")
PLAIN_ATTRIBUTE = re.compile(rf"""({_NAME})=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose text is no markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
FACT_PARTS = frozenset("context unit instant enddate startdate measure segment explicitmember typedmember".split())


class _Facts(HTMLParser):
    """Elements of an inline-fact document: facts, contexts, units."""

    def __init__(self, source: str):
        super().__init__()
        self._clear()
        if not self._plain(source):
            self._clear()
            self.feed(source)
            self.close()

    def _clear(self):
        self.facts, self.contexts, self.units, self.open = [], {}, {}, []

    def _plain(self, source: str) -> bool:
        """Whether the source is plain tags and text throughout; then it has been gone through, the tags that don't count unparsed."""
        at = 0
        while m := PLAIN_TAG.match(source, at):
            at = m.end()
            data, closing, tag, attributes, empty = m.groups()
            tag = tag.lower()
            if tag in RAW or (closing and (attributes or empty)):
                return False
            if data and self.open:
                self.handle_data(unescape(data))
            if closing:
                self.handle_endtag(tag)
                continue
            if tag.split(":")[-1] in FACT_PARTS or "contextref" in attributes.lower():
                if "&" in attributes:
                    return False
                self.handle_starttag(tag, [(k.lower(), x or y) for k, x, y in PLAIN_ATTRIBUTE.findall(attributes)])
            if empty:
                self.handle_endtag(tag)
        return "<" not in source[at:]

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        name = tag.split(":")[-1]
        if "contextref" in at:
            self.open.append((tag, "fact", [at, ""]))
        elif name in ("context", "unit") and "id" in at:
            (self.contexts if name == "context" else self.units)[at["id"]] = {}
            self.open.append((tag, name, at["id"]))
        elif name in ("instant", "enddate", "startdate", "measure"):
            self.open.append((tag, name, ""))
        elif name in ("segment", "explicitmember", "typedmember"):
            for _, kind, key in self.open:
                if kind == "context":
                    self.contexts[key]["dimensional"] = True

    def handle_data(self, data):
        for i, (tag, kind, x) in enumerate(self.open):
            if kind == "fact":
                x[1] += data
            elif kind in ("instant", "enddate", "startdate", "measure"):
                self.open[i] = (tag, kind, x + data)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, kind, x = self.open.pop(i)
                if kind == "fact":
                    self.facts.append(x)
                elif kind in ("instant", "enddate", "startdate", "measure"):
                    owner = next(((k, key) for _, k, key in reversed(self.open) if k in ("context", "unit")), None)
                    if owner:
                        (self.contexts if owner[0] == "context" else self.units)[owner[1]].setdefault(kind, x.strip())
                return


def inline_facts(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """(keys, seq, concept, raw, scale, sign, period_end, start_date, dimensional, measure): facts joined to their context and unit."""

    def run(frames):
        for f in frames:
            rows = []
            for row in f.to_dict("records"):
                d = _Facts(row[html] or "")
                for i, (at, text) in enumerate(d.facts):
                    c = d.contexts.get(at["contextref"])
                    if c is None:
                        continue
                    rows.append([*(row[k] for k in keys), i, at.get("name"), text, at.get("scale"), at.get("sign"), c.get("instant") or c.get("enddate"), c.get("startdate"), bool(c.get("dimensional")), d.units.get(at.get("unitref"), {}).get("measure")])
            yield pd.DataFrame(rows, columns=[*keys, "seq", "concept", "raw", "scale", "sign", "period_end", "start_date", "dimensional", "measure"])

    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_in_frames(pages.select(*keys, html), run, f"{fields}, seq int, concept string, raw string, scale string, sign string, period_end string, start_date string, dimensional boolean, measure string")


def facts_of(inline: DataFrame, *keys: str) -> DataFrame:
    """Facts as ``quire.operators.facts`` takes them: value, duration in days, currency."""
    from pyspark.sql import functions as F

    from quire.functions.numbers import fact_value

    days = F.coalesce(F.datediff(F.col("period_end").try_cast("date"), F.col("start_date").try_cast("date")), F.lit(0))
    code = F.upper(F.regexp_extract(F.coalesce("measure", F.lit("")), r"iso4217:([A-Za-z]{3})", 1))
    return inline.select(*keys, "seq", "concept", "period_end", days.alias("duration"), fact_value(F.col("raw"), F.col("scale"), F.col("sign")).alias("value"), F.nullif(code, F.lit("")).alias("currency"), "dimensional")


def longest_frame(frames: DataFrame, *keys: str, text: str = "text", least: int = LEAST_FRAME, top: str = "is_top", order: str | None = None) -> DataFrame:
    """(keys, text): of each page the frame with the longest text, if that has ``least`` characters; else the top document."""
    from pyspark.sql import functions as F

    size = F.length(text) if order is None else F.struct(F.length(text), order)  # of equally long frames the last in an order
    inner = F.max_by(text, F.when(~F.col(top), size))
    return frames.groupBy(*keys).agg(inner.alias("_inner"), F.max_by(text, F.when(F.col(top), F.length(text))).alias("_top")).select(*keys, F.when(F.length("_inner") >= least, F.col("_inner")).otherwise(F.col("_top")).alias("text"))
