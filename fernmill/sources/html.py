"""Typed records from stored HTML pages of job lists and job details.

A small element tree is built with the standard library's parser and queried with a few
class and attribute tests; pages are parsed in Arrow batches. A page that doesn't have the
expected shape gives a row with an ``error`` instead of stopping the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("p div li tr dd dt h1 h2 h3 h4 h5 h6 ul ol table section article blockquote pre".split())
#: An open element of the first kind ends where one of the second kind begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": BLOCK, "option": {"option"}}
#: What decorates a value on the page without being part of it.
BUTTON_WORDS = frozenset(["지도", "지도보기", "상세보기", "더보기", "위치보기"])
HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none")
LAYER_CLASS = re.compile(r"(?i)(map|layer)([_-].*)?|.*[_-](map|layer)")
COMPANY_KEY = re.compile(r"(?<![A-Za-z0-9_])csn=([^&#\"']+)")
TAG_CODE = re.compile(r"cat_kewd=(\d{1,9})(?!\d)")
PERIOD = "%Y.%m.%d %H:%M"


class Node:
    """An element (name, attributes, children) or a text (``name`` None)."""

    __slots__ = ("name", "attrs", "children", "parent", "data")

    def __init__(self, name: str | None, attrs: dict[str, str] | None = None, data: str = ""):
        self.name, self.attrs, self.children, self.parent, self.data = name, attrs or {}, [], None, data

    def add(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if n.name:
                yield n
                stack.extend(reversed(n.children))

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next(filter(test, self.walk()), None)

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return list(filter(test, self.walk()))

    def copy(self) -> Node:
        n = Node(self.name, dict(self.attrs), self.data)
        for c in self.children:
            n.add(c.copy())
        return n

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)

    def raw(self) -> str:
        if self.name is None:
            return self.data
        return "".join(c.raw() for c in self.children)

    def text(self) -> str:
        """The text with white space as single spaces; block elements and breaks part words."""
        out: list[str] = []

        def put(n: Node) -> None:
            if n.name is None:
                out.append(n.data)
            elif n.name not in ("script", "style"):
                gap = n.name in BLOCK or n.name in ("br", "td", "th")
                out.append(" " * gap)
                for c in n.children:
                    put(c)
                out.append(" " * gap)

        put(self)
        return re.sub(r"[ \t\n\f\r]+", " ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):  # type: ignore[no-untyped-def]
        ends = {k for k, v in CLOSES.items() if tag in v}
        n = self.at
        while n.parent and n.name in ends:
            self.at = n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.at.add(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):  # type: ignore[no-untyped-def]
        self.at.add(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):  # type: ignore[no-untyped-def]
        n = self.at
        while n.parent and n.name != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):  # type: ignore[no-untyped-def]
        self.at.add(Node(None, data=data))


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def has_class(*names: str, tag: str | None = None) -> Callable[[Node], bool]:
    return lambda n: (tag is None or n.name == tag) and set(names) <= set(n.classes())


def inside(outer: Callable[[Node], bool], inner: Callable[[Node], bool]) -> Callable[[Node], bool]:
    """Elements of the second kind with an ancestor of the first."""

    def test(n: Node) -> bool:
        if not inner(n):
            return False
        p = n.parent
        while p is not None:
            if p.name and outer(p):
                return True
            p = p.parent
        return False

    return test


def single_spaced(s: str) -> str:
    return re.sub(r"\s+", " ", s.replace("\u00a0", " ")).strip()


def decoded_key(v: str) -> str:
    """Percent escapes resolved, plus signs kept; a malformed value as it is."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", v):
        return v
    return unquote(v)


# -- list pages ---------------------------------------------------------------------------
ITEM_TYPE = (
    "struct<posting_id:bigint,title:string,company_name:string,company_csn:string,group_name:string,size_label:string,headhunting:boolean,"
    "sector_preview:array<string>,region:string,career_text:string,education_text:string,deadline_text:string,posted_text:string>"
)


def _text_of(root: Node | None, test: Callable[[Node], bool]) -> str | None:
    n = root.first(test) if root else None
    return n.text() if n else None


def _item(it: Node) -> dict:
    link = it.first(inside(has_class("job_tit"), lambda n: n.name == "a"))
    title = (link.text() or link.attrs.get("title", "").strip()) if link else ""
    company = it.first(has_class("company_nm"))
    name = company.first(has_class("str_tit")) if company else None
    key = None
    if name and (m := COMPANY_KEY.search(name.attrs.get("href", ""))):
        key = decoded_key(m[1])
    if key is None and company and (b := company.first(lambda n: n.name == "button" and n.attrs.get("csn", "").strip() != "")):
        key = b.attrs["csn"]
    support = has_class("support_detail")
    return {
        "posting_id": int(it.attrs["id"][4:]),
        "title": title,
        "company_name": name.text() if name else "",
        "company_csn": key,
        "group_name": _text_of(company, has_class("main_corp", tag="span")),
        "size_label": _text_of(company, has_class("info_stock", tag="span")),
        "headhunting": bool(company and "헤드헌팅" in company.text()),
        "sector_preview": [s.text() for s in it.all(lambda n: n.name == "span" and n.parent is not None and "job_sector" in n.parent.classes()) if s.text()],
        "region": _text_of(it, has_class("work_place", tag="p")),
        "career_text": _text_of(it, has_class("career", tag="p")),
        "education_text": _text_of(it, has_class("education", tag="p")),
        "deadline_text": _text_of(it, inside(support, has_class("date"))),
        "posted_text": _text_of(it, inside(support, has_class("deadlines"))),
    }


def parse_list(html: str | None) -> dict:
    """{total_count, items, raw_item_count, error} of a list page; an error where it is no list."""
    root = tree(html or "")
    if root.first(has_class("list_body")) is None:
        return {"total_count": None, "items": None, "raw_item_count": None, "error": "no list on the page"}
    total = root.first(inside(has_class("total_count"), lambda n: n.name == "em"))
    digits = re.sub(r"[^0-9]", "", total.text()) if total else ""
    raw = root.all(lambda n: "list_item" in n.classes() and n.attrs.get("id", "").startswith("rec-"))
    items = [_item(n) for n in raw if re.fullmatch(r"\d{1,18}", n.attrs["id"][4:])]
    return {"total_count": int(digits) if 0 < len(digits) <= 9 else None, "items": items, "raw_item_count": len(raw), "error": None}


# -- detail pages -------------------------------------------------------------------------
DETAIL_TYPE = (
    "struct<title:string,summary:map<string,string>,required:array<string>,preferred:array<string>,tags:array<struct<code:int,name:string>>,"
    "start_at:timestamp_ntz,end_at:timestamp_ntz,error:string>"
)


def text_lines(box: Node | None) -> list[str]:
    """The lines of a box: breaks and blocks end a line, cells part words, a leading label gets a colon."""
    if box is None:
        return []
    out: list[str] = []

    def put(n: Node, top: bool = False) -> None:
        if n.name is None:
            out.append(n.data)
            return
        if n.name == "br":
            out.append("\n")
            return
        block = n.name in BLOCK
        out.append("\n" * block)
        for c in n.children:
            put(c)
        out.append("\n" * block + " " * (n.name in ("td", "th")))
        parent = n.parent
        if n.name == "span" and not top and parent is not None and parent.name == "li":
            elements = [c for c in parent.children if c.name]
            if elements and elements[0] is n and parent.children[-1] is not n:
                out.append(": ")

    put(box, top=True)
    lines = (s.replace("\u00a0", " ").strip() for s in "".join(out).split("\n"))
    return [s for s in lines if s]


def _decoration(n: Node, tooltips: bool) -> bool:
    classes = n.classes()
    if n.name in ("button", "script", "style") or "blind" in classes or n.attrs.get("id", "").startswith("details-"):
        return True
    if HIDDEN_STYLE.search(n.attrs.get("style", "")):
        return True
    word = single_spaced(n.text()).replace(" ", "")
    if n.name == "a" and word in BUTTON_WORDS:
        return True
    if (word in BUTTON_WORDS or not word) and any(LAYER_CLASS.fullmatch(c) for c in classes):
        return True
    joined = " ".join(classes).lower()
    return tooltips and "tooltip" in joined and "wrap" not in joined


def _bare(dd: Node, tooltips: bool) -> Node:
    copy = dd.copy()
    for n in [n for n in copy.walk() if _decoration(n, tooltips)]:
        n.remove()
    return copy


def summary_value(dd: Node) -> str:
    """A summary cell's value: without buttons, tooltips and hidden layers; strong text is the value."""
    strict = _bare(dd, True)
    strong = strict.first(lambda n: n.name == "strong")
    if v := single_spaced((strong or strict).text()):
        return v
    loose = _bare(dd, False)
    strong = loose.first(lambda n: n.name == "strong")
    if strong and (v := single_spaced(strong.text())):
        return v
    own = single_spaced(" ".join(c.data for c in loose.children if c.name is None))
    return own or single_spaced(loose.text())


def _moment(text: str) -> datetime | None:
    t = text.strip()
    if not re.search(r"\d", t):
        return None
    return datetime.strptime(t, PERIOD)


def parse_detail(html: str | None) -> dict:
    """The fields of a detail page, or ``error`` where the page lacks what each must have."""
    empty = dict.fromkeys(("title", "summary", "required", "preferred", "tags", "start_at", "end_at", "error"))
    root = tree(html or "")
    box = root.first(has_class("jv_summary"))
    if box is None:
        return empty | {"error": "no summary"}
    in_tags = inside(has_class("jv_footer"), inside(has_class("tags"), lambda n: n.name == "a" and "cat_kewd" in n.attrs.get("href", "")))
    tags = [{"code": int(m[1]), "name": re.sub(r"^#", "", a.text()).strip()} for a in root.all(in_tags) if (m := TAG_CODE.search(a.attrs["href"]))]
    if not tags:
        return empty | {"error": "no tag with a code"}
    summary: dict[str, str] = {}
    for dl in box.all(lambda n: n.name == "dl"):
        dt, dd = dl.first(lambda n: n.name == "dt"), dl.first(lambda n: n.name == "dd")
        if dt and dd:
            summary[dt.text()] = summary_value(dd)
    of = lambda prefix: text_lines(box.first(lambda n: n.attrs.get("id", "").startswith(prefix)))
    required, preferred = of("details-required-"), of("details-preferred-")
    if "자격요건" in summary and not required or "우대사항" in summary and not preferred:
        return empty | {"error": "a named section has no text"}
    start = end = None
    period = root.first(inside(has_class("jv_howto"), has_class("info_period")))
    for dt in period.all(lambda n: n.name == "dt") if period else ():
        after = [c for c in dt.parent.children if c.name]
        k = after.index(dt) + 1
        if k == len(after):
            continue
        try:
            at = _moment(after[k].text())
        except ValueError:
            return empty | {"error": "a period in another form"}
        if "시작" in dt.text():
            start = at
        elif "마감" in dt.text():
            end = at
    title = root.first(has_class("tit_job", tag="h1"))
    return {"title": title.text() if title else None, "summary": summary, "required": required, "preferred": preferred, "tags": tags, "start_at": start, "end_at": end, "error": None}


# -- tables -------------------------------------------------------------------------------
def _parsed(pages: DataFrame, html: str, kind: str, parse: Callable[[str | None], dict]) -> DataFrame:
    rest = [c for c in pages.columns if c != html]
    schema = pages.drop(html).withColumn("page", F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        target = to_arrow_type(schema["page"].dataType)
        for b in batches:
            found = [parse(x) for x in b.column(b.schema.get_field_index(html)).to_pylist()]
            page = pa.array([f | {"summary": list(f["summary"].items())} if f.get("summary") is not None else f for f in found], target)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], page], names=[*rest, "page"])

    return pages.select(*rest, html).mapInArrow(run, schema)


def list_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with a struct ``page`` (total_count, items, raw_item_count, error) for their HTML."""
    return _parsed(pages, html, f"struct<total_count:int,items:array<{ITEM_TYPE}>,raw_item_count:int,error:string>", parse_list)


def list_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each item of the pages that are lists."""
    rest = [c for c in pages.columns if c != html]
    return list_pages(pages, html).where("page.error is null").select(*rest, F.explode("page.items").alias("item")).select(*rest, "item.*")


def detail_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with a struct ``page`` of a detail's fields for their HTML."""
    return _parsed(pages, html, DETAIL_TYPE, parse_detail)


def last_page(raw_item_count, page_size: int = 100):  # type: ignore[no-untyped-def]
    """Whether a list page is the last: it is not full."""
    return raw_item_count < page_size
