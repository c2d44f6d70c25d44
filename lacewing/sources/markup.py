"""Markup as arrays of nodes, and selections from them as column expressions.

A page is tokenized once, batch by batch; quoting, the order of attributes and elements of one name within each other are settled
there. `nodes` gives all of a page to expressions on the JVM; `picked` gives just the attributes and texts that a query names, which is
what many pages need: a node that nobody reads costs neither a row of its own nor a scan. Plain pages are read as columns (`tokens`),
all others one by one, with a stack of open elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from ..functions.scalars import collapse, with_value
from .tokens import ENDS, OPENS, STANDS, TORN, Form, Tokens, ranges

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TEXT, COMMENT = "#text", "#comment"
#: at counts nodes in the order they begin, last is the last node within, parent is -1 at the top; of attributes that repeat the last counts.
NODES = ArrayType(StructType([StructField("tag", StringType()), *[StructField(c, IntegerType()) for c in ("at", "last", "parent")], StructField("attrs", MapType(StringType(), StringType())), StructField("value", StringType())]))


class _Nodes(HTMLParser):
    """An end tag closes the last open element of its name and all that were opened in it; one without such an element is nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], []

    def node(self, tag: str, attrs: dict[str, str], value: str | None) -> int:
        self.found.append({"tag": tag, "at": len(self.found), "last": len(self.found), "parent": self.open[-1] if self.open else -1, "attrs": list(attrs.items()), "value": value})
        return len(self.found) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self.node(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.node(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[k]]["tag"] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        inside = self.found[self.open[-1]]["tag"] if self.open else ""
        self.node(f"#{inside}" if inside in ("script", "style") else TEXT, {}, data)

    def handle_comment(self, data: str) -> None:
        self.node(COMMENT, {}, data)

    def _close(self, k: int) -> None:
        for at in self.open[k:]:
            self.found[at]["last"] = len(self.found) - 1
        del self.open[k:]

    def read(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._close(0)
        return self.found


#: Characters of pages that are held as Python objects at once, and bytes of pages that are read as columns at once.
PAGES_AT_ONCE = 1 << 20
BYTES_AT_ONCE = 1 << 21


def _slices(html: pa.Array) -> Iterator[list[str | None]]:
    """The pages of a batch, some at a time."""
    out, size = [], 0
    for x in html:
        out.append(x.as_py())
        size += len(out[-1] or "")
        if size >= PAGES_AT_ONCE:
            yield out
            out, size = [], 0
    yield out


@F.arrow_udf(NODES)
def nodes(html: pa.Array) -> pa.Array:
    """The nodes of each page: elements, texts and comments in the order they begin. Null gives null, an empty page none."""
    return pa.concat_arrays([pa.array([_Nodes().read(x) if x is not None else None for x in some], to_arrow_type(NODES)) for some in _slices(html)])


#: Tokens of plain markup, its tags, and elements whose content is read in another way.
_TOKEN = re.compile(r"<!-- [^-]*-->|<[^<>]*>|[^<]+")
_PLAIN = re.compile(r"""<([a-z][a-z0-9]*)((?: [a-z][a-z0-9_-]*=(?:"[^"&]*"|'[^'&]*'))*)>""")
_PAIR = re.compile(r""" ([a-z][a-z0-9_-]*)=(?:"([^"]*)"|'([^']*)')""")
_TAG = re.compile(r"""<[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][A-Za-z0-9_-]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]+))?)*\s*/?>""", re.ASCII)
_END = re.compile(r"</([A-Za-z][A-Za-z0-9]*)[ \n]*>")
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
_SPACES = re.compile(r"[ \t\n\r\x0B\f]+")
#: Tags that are remembered, of those that have stood in earlier pages.
_TAGS = 1 << 14
THIS = "#this"
#: Nodes that no pick chooses: tag, attributes, whether it stays open, picks.
_TEXT_MARK, _COMMENT_MARK = (TEXT, {}, False, ()), (COMMENT, {}, False, ())


class Pick(NamedTuple):
    """What is read of each chosen element, in order: its `text`, the text that stands in it itself (`own`), the `value` of a script, an
    attribute (`@name`), or picks within it. It is chosen by tag, class, attributes and the beginnings of attributes, and may have to
    stand in an element of class `within`; the tag THIS is the element whose picks these are."""

    what: str | dict[str, Pick]
    tag: str | None = None
    css: str | None = None
    attrs: tuple[tuple[str, str], ...] = ()
    begins: tuple[tuple[str, str], ...] = ()
    within: str | None = None

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        return (
            self.tag in (None, tag) and (self.css is None or _of_class(attrs, self.css))
            and all(attrs.get(k) == v for k, v in self.attrs) and all(attrs.get(k, "").startswith(v) and k in attrs for k, v in self.begins)
        )


def _of_class(attrs: dict[str, str], css: str) -> bool:
    return css in _SPACES.split(attrs.get("class", ""))


class _Start(HTMLParser):
    """One start tag."""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.read = tag, {k: v or "" for k, v in attrs}, tag not in VOID

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.read = tag, {k: v or "" for k, v in attrs}, False


class _Out:
    """The values of a pick, as they go into a list array."""

    def __init__(self, what: str | dict[str, Pick]):
        self.offsets, self.size = [0], 0
        self.values = {k: _Out(p.what) for k, p in what.items()} if isinstance(what, dict) else []

    def end(self) -> None:
        self.offsets.append(self.size)

    def array(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), _struct(self.values, self.size) if isinstance(self.values, dict) else pa.array(self.values, pa.string()))


def _struct(values: dict[str, _Out], size: int, null: pa.Array | None = None) -> pa.Array:
    return pa.StructArray.from_arrays([o.array() for o in values.values()], names=list(values), mask=null)


class _Picker:
    """Reads pages by picks: what a tag is chosen for is found once for all the tags that are written alike."""

    def __init__(self, picks: dict[str, Pick]):
        self.picks, self.known, self.by_tag, self.by_class, self.others = picks, {}, {}, {}, []
        self._list(picks)
        self.ends, self.scripts = {}, {x: (f"#{x}", {}, False, self._hits(f"#{x}", {})) for x in ("script", "style")}

    def _list(self, picks: dict[str, Pick]) -> None:
        for p in picks.values():
            if p.tag is not None:
                self.by_tag.setdefault(p.tag, []).append(p)
            elif p.css is not None:
                self.by_class.setdefault(p.css, []).append(p)
            else:
                self.others.append(p)
            if p.within is not None:
                self.by_class.setdefault(p.within, []).append(p.within)
            if isinstance(p.what, dict):
                self._list(p.what)

    def _hits(self, tag: str, attrs: dict[str, str]) -> tuple:
        """The picks, by identity, that an element is chosen for, and the classes that picks have to stand in."""
        classes = set(_SPACES.split(attrs["class"])) if "class" in attrs else ()
        may = [*self.by_tag.get(tag, ()), *self.others, *[p for c in classes for p in self.by_class.get(c, ())]]
        return tuple({*[p for p in may if p.__class__ is str], *[id(p) for p in may if p.__class__ is Pick and p.fits(tag, attrs)]}) if may else ()

    def _tag(self, raw: str) -> tuple | None:
        """(tag, attributes, whether it stays open, picks) of a start tag; null if its reading may depend on what follows."""
        plain = _PLAIN.fullmatch(raw)
        if plain:
            tag, attrs = plain[1], {k: a or b for k, a, b in _PAIR.findall(plain[2])}
            stays = tag not in VOID
        elif _TAG.fullmatch(raw):
            one = _Start()
            one.feed(raw)
            tag, attrs, stays = one.read
        else:
            return None
        if tag in _RAW and (tag not in ("script", "style", "title") or not stays):
            return None
        if len(self.known) >= _TAGS:
            self.known.clear()
        found = self.known[raw] = tag, attrs, stays, self._hits(tag, attrs)
        return found

    def page(self, html: str) -> tuple[list, list, list, list] | None:
        """The page's nodes as columns, if it is plain markup, which HTMLParser reads alike."""
        tokens = _TOKEN.findall(html)
        if sum(map(len, tokens)) != len(html) or "\x00" in html:
            return None
        marks, lasts, parents, values = [], [], [], []
        open_, known, ends, raw = [], self.known, self.ends, None
        for token in tokens:
            if token[0] != "<":
                mark, value = (self.scripts[raw], token) if raw in self.scripts else (_TEXT_MARK, unescape(token) if "&" in token else token)
            elif token[1] == "/":
                name = ends.get(token)
                if name is None:
                    end = _END.fullmatch(token)
                    if end is None:
                        return None
                    name = ends[token] = end[1].lower()
                if raw is not None and name != raw:
                    return None
                raw = None
                for k in range(len(open_) - 1, -1, -1):
                    if marks[open_[k]][0] == name:
                        for at in open_[k:]:
                            lasts[at] = len(marks) - 1
                        del open_[k:]
                        break
                continue
            elif raw is not None:
                return None
            elif token[1] == "!":
                if not token.startswith("<!-- "):
                    return None
                mark, value = _COMMENT_MARK, token[4:-3]
            else:
                mark, value = known.get(token) or self._tag(token), None
                if mark is None:
                    return None
                raw = mark[0] if mark[0] in _RAW else None
            parents.append(open_[-1] if open_ else -1)
            if mark[2]:
                open_.append(len(marks))
            lasts.append(len(marks))
            marks.append(mark)
            values.append(value)
        if raw is not None:
            return None
        for at in open_:
            lasts[at] = len(marks) - 1
        return marks, lasts, parents, values

    def slow(self, html: str) -> tuple[list, list, list, list]:
        found = _Nodes().read(html)
        marks = [_TEXT_MARK if n["tag"] == TEXT else (n["tag"], dict(n["attrs"]), False, self._hits(n["tag"], dict(n["attrs"]))) for n in found]
        return marks, [n["last"] for n in found], [n["parent"] for n in found], [n["value"] for n in found]

    def read(self, page: tuple, first: int, last: int, picks: dict[str, Pick], out: dict[str, _Out]) -> None:
        """The picks of the nodes from `first` to `last`, which are those within `first` - 1."""
        marks, lasts, parents, values = page
        reach: dict[str, int] = {}
        text = lambda parts: _SPACES.sub(" ", parts[0] if len(parts) == 1 else " ".join(parts)).strip(" ")

        def take(pick: Pick, into: _Out, at: int) -> None:
            if isinstance(pick.what, dict):
                self.read(page, at + 1, lasts[at], pick.what, into.values)
            elif pick.what == "text":
                into.values.append(text([values[i] for i in range(at + 1, lasts[at] + 1) if marks[i] is _TEXT_MARK]))
            elif pick.what == "own":
                into.values.append(text([values[i] for i in range(at + 1, lasts[at] + 1) if marks[i] is _TEXT_MARK and parents[i] == at]))
            else:
                into.values.append(values[at] if pick.what == "value" else marks[at][1].get(pick.what[1:]))
            into.size += 1

        wanted = {}
        for name, pick in picks.items():
            if pick.tag == THIS:
                take(pick, out[name], first - 1)
            else:
                wanted[id(pick)] = wanted.get(id(pick), []) + [(pick, out[name])]
        for at in range(first, last + 1):
            hits = marks[at][3]
            if hits:
                for key in hits:
                    for pick, into in wanted.get(key, ()):
                        if pick.within is None or at <= reach.get(pick.within, -1):
                            take(pick, into, at)
                for key in hits:
                    if key.__class__ is str:
                        reach[key] = max(reach.get(key, -1), lasts[at])
        for into in out.values():
            into.end()

    def array(self, pages: list[str | None]) -> pa.Array:
        out = {k: _Out(p.what) for k, p in self.picks.items()}
        for html in pages:
            page = self.page(html or "") or self.slow(html)
            self.read(page, 0, len(page[0]) - 1, self.picks, out)
        return _struct(out, len(pages), pa.array([x is None for x in pages], pa.bool_()))


_EMPTY = re.compile(r"""""|''""")


class _Columns(_Picker):
    """Reads plain pages by picks as columns, and the others as ever."""

    def __init__(self, picks: dict[str, Pick]):
        super().__init__(picks)
        self.written = {}

    def form(self, raw: str) -> Form:
        """What a tag without its values is."""
        found = self.written.get(raw)
        if found is None:
            if len(self.written) >= _TAGS:
                self.written.clear()
            found = self.written[raw] = self._form(raw)
        return found

    def _form(self, raw: str) -> Form:
        end = _END.fullmatch(raw)
        if end is not None:
            return Form(ENDS, end[1].lower())
        if _TAG.fullmatch(raw) is None or "\x01" in raw:
            return Form(TORN)
        at = iter(range(len(raw)))
        one = _Start()
        one.feed(_EMPTY.sub(lambda quotes: f"{quotes[0][0]}\x01{next(at)}{quotes[0][0]}", raw))
        tag, attrs, stays = one.read
        if tag in _RAW and (tag not in ("script", "style", "title") or not stays):
            return Form(TORN)
        return Form(OPENS if stays else STANDS, tag, tag in _RAW, {k: int(v[1:]) if v.startswith("\x01") else v for k, v in attrs.items()})

    def array(self, html: pa.StringArray) -> pa.StructArray:
        """The picks of all pages. Null gives null."""
        null, html = html.is_null(), html.fill_null("")
        page = _Page(html, self)
        first = page.tokens.page_token
        out = pa.StructArray.from_arrays([page.held(p, first[:-1] - 1, first[1:] - 1) for p in self.picks.values()], names=list(self.picks), mask=null)
        torn = page.tokens.torn
        if not torn.any():
            return out
        slow = [super(_Columns, self).array(some) for some in _slices(html.filter(pa.array(torn)))]
        at = np.arange(len(torn))
        at[torn] = len(torn) + np.arange(torn.sum())
        return pa.concat_arrays([out, *slow]).take(pa.array(at))


class _Page:
    """Plain pages, and what picks choose in them: elements are told by their tokens, in order."""

    def __init__(self, html: pa.StringArray, reader: _Columns):
        t = self.tokens = Tokens(html, reader.form)
        elements = np.flatnonzero((t.kind == OPENS) | (t.kind == STANDS))
        form = t.form[elements]
        order = np.argsort(form.astype(np.int16) if len(t.forms) < 1 << 15 else form, kind="stable")
        self.by_form, self.form_ends = elements[order], np.searchsorted(form[order], np.arange(len(t.forms) + 1))
        self.coded, self.fitting = {}, {}
        self.ended = np.arange(len(t.is_tag))
        self.ended[t.token] = t.token[t.last]

    def _having(self, names: set[str], tag: str | None) -> np.ndarray:
        """The tags of elements that have these attributes."""
        some = [i for i, f in enumerate(self.tokens.forms) if tag in (None, f.name) and names <= f.attrs.keys()]
        parts = [self.by_form[self.form_ends[i] : self.form_ends[i + 1]] for i in some]
        return np.sort(np.concatenate(parts)) if parts else self.by_form[:0]

    def _fitting(self, name: str, test: str, value: str) -> np.ndarray:
        """The tags of elements whose attribute passes a test, which is made of each value once."""
        if name not in self.coded:
            tags = self._having({name}, None)
            self.coded[name] = tags, self._attribute(name, tags).dictionary_encode()
        if (name, test, value) not in self.fitting:
            tags, found = self.coded[name]
            good = np.array([value in _SPACES.split(x) for x in found.dictionary.to_pylist()], bool) if test == "css" else {"attrs": pc.equal, "begins": pc.starts_with}[test](found.dictionary, value).to_numpy(zero_copy_only=False).astype(bool)
            self.fitting[name, test, value] = tags[good[found.indices.to_numpy()]]
        return self.fitting[name, test, value]

    def _attribute(self, name: str, tags: np.ndarray) -> pa.StringArray:
        return self.tokens.attribute(name, tags, _attribute)

    def chosen(self, pick: Pick) -> np.ndarray:
        """The tokens that a pick chooses, without regard to where they have to stand."""
        t = self.tokens
        tests = [("class", "css", pick.css)] * (pick.css is not None) + [(k, "attrs", v) for k, v in pick.attrs] + [(k, "begins", v) for k, v in pick.begins]
        found = [self._fitting(*test) for test in tests] or [self._having(set(), pick.tag)]
        tags = found[0]
        for more in found[1:]:
            tags = np.intersect1d(tags, more, assume_unique=True)
        if pick.tag is not None and tests:
            tags = tags[np.array([f.name == pick.tag for f in t.forms], bool)[t.form[tags]]]
        tokens = t.token[tags]
        if tests or (pick.tag is not None and not pick.tag.startswith("#")) or not len(t.scripts):
            return tokens
        scripts = t.scripts if pick.tag is None else t.scripts[t.by_form(lambda f: f"#{f.name}" == pick.tag, bool)[t.script_tag]]
        return np.sort(np.concatenate((tokens, scripts)))

    def held(self, pick: Pick, after: np.ndarray, last: np.ndarray) -> pa.ListArray:
        """The values of a pick within each of some places: from the token behind `after` to `last`."""
        if pick.tag == THIS:
            return _listed(np.arange(len(after) + 1), self.values(pick, after))
        found = self.chosen(pick)
        offsets, at = ranges(np.searchsorted(found, after, "right"), np.searchsorted(found, last, "right"))
        if pick.within is not None:
            fits = self._around(pick.within, found)[at] > np.repeat(after, np.diff(offsets))
            offsets, at = np.concatenate(([0], np.cumsum(fits)))[offsets], at[fits]
        values = self.values(pick, found)
        return _listed(offsets, values if len(at) == len(found) and (at == np.arange(len(at))).all() else values.take(pa.array(at)))

    def _around(self, css: str, found: np.ndarray) -> np.ndarray:
        """The token of the innermost element of a class around each token; -1 if there is none."""
        begin = self.tokens.token[self._fitting("class", "css", css)]
        begin = begin[self.ended[begin] > begin]
        end, outer = np.append(self.ended[begin], len(self.ended)), np.full(len(begin) + 1, -1)
        if (end[:-2] > begin[1:]).any():  # some stand within each other
            open_ = []
            for i, (first, last) in enumerate(zip(begin.tolist(), end.tolist())):
                while open_ and open_[-1][1] < first:
                    open_.pop()
                outer[i] = open_[-1][0] if open_ else -1
                open_.append((i, last))
        at = np.searchsorted(begin, found) - 1
        while (over := (at >= 0) & (end[at] < found)).any():
            at[over] = outer[at[over]]
        return np.where(at >= 0, np.append(begin, -1)[at], -1)

    def values(self, pick: Pick, found: np.ndarray) -> pa.Array:
        """What is read of each of these elements."""
        t, what = self.tokens, pick.what
        if isinstance(what, dict):
            return pa.StructArray.from_arrays([self.held(p, found, self.ended[found]) for p in what.values()], names=list(what))
        if what in ("text", "own"):
            offsets, at = ranges(t.texts_before[found], t.texts_before[self.ended[found]])
            if what == "own":
                tags = t.tags_before[found]
                inside = np.where(t.is_tag[found], t.depth[tags - (tags == len(t.depth))] + 1, -1) if len(t.depth) else tags
                fits = t.text_depth[at] == np.repeat(inside, np.diff(offsets))
                offsets, at = np.concatenate(([0], np.cumsum(fits)))[offsets], at[fits]
            return pc.binary_join(_listed(offsets, t.texts.take(pa.array(at))), " ")
        tag = t.is_tag[found]
        if what == "value":
            return t.all.take(pa.array(found, mask=tag))
        tags = t.tags_before[found[tag]]
        values = self._attribute(what[1:], tags)
        return values if tag.all() else values.take(pa.array(np.cumsum(tag) - 1, mask=~tag))


def _listed(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _attribute(raw: str) -> str:
    """What an attribute means that is written so."""
    one, quote = _Start(), "'" if '"' in raw else '"'
    one.feed(f"<a x={quote}{raw}{quote}>")
    return one.read[1]["x"]


def _kind(what: str | dict[str, Pick]) -> str:
    return f"array<struct<{','.join(f'{k}:{_kind(p.what)}' for k, p in what.items())}>>" if isinstance(what, dict) else "array<string>"


def picked(html: Column | str, **picks: Pick) -> Column:
    """A struct of each page's picks, arrays of strings or of structs of picks. Null gives null."""

    def read(html: pa.Array) -> pa.Array:
        reader = _Columns(picks)
        return pa.concat_arrays([reader.array(some) for some in _pieces(html)])

    return F.arrow_udf(read, _kind(picks).removeprefix("array<").removesuffix(">"))(html)


def _pieces(html: pa.StringArray) -> Iterator[pa.StringArray]:
    """The pages of a batch, some at a time."""
    ends = np.frombuffer(html.buffers()[1], np.int32)[html.offset : html.offset + len(html) + 1]
    first = 0
    while first < len(html):
        last = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + BYTES_AT_ONCE, "right")) - 1)
        yield html.slice(first, last - first)
        first = last
    if not len(html):
        yield html


def inside(found: Column, node: Column) -> Column:
    """All nodes within `node`, which is one of `found`, the nodes of the whole page."""
    return F.slice(found, node["at"] + 2, node["last"] - node["at"])


def attribute(node: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(node["attrs"], lambda k, _: k == name)), F.lit(0))


def has_class(node: Column, css: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(node, "class"), r"\s+"), css), F.lit(False))


def tagged(found: Column, tag: str, **attributes: str) -> Column:
    """The elements of `found` of that tag with those attributes."""
    return F.filter(found, lambda n: F.coalesce(_all([n["tag"] == tag, *[attribute(n, k) == v for k, v in attributes.items()]]), F.lit(False)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def classed(found: Column, *css: str) -> Column:
    """The elements of `found` of all those classes."""
    return F.filter(found, lambda n: _all([has_class(n, c) for c in css]))


def text_of(found: Column) -> Column:
    """The text in `found`, on one line; scripts, styles and comments have none."""
    return collapse(F.array_join(F.transform(F.filter(found, lambda n: n["tag"] == TEXT), lambda n: n["value"]), " "))


def texts(page: Column, chosen: Column) -> Column:
    """The text within each of the `chosen` nodes of a page."""
    return F.transform(chosen, lambda n: text_of(inside(page, n)))


def own_text(found: Column, node: Column) -> Column:
    """The text that stands in `node` itself, not in an element within it."""
    return text_of(F.filter(found, lambda n: n["parent"] == node["at"]))


def only(values: Column) -> Column:
    """The only element of an array; null if there are none or several, or it is blank."""
    return with_value(values, lambda v: F.when((F.size(v) == 1) & (F.get(v, F.lit(0)) != ""), F.get(v, F.lit(0))))


def single(values: Column) -> Column:
    """`only` of values that lie at hand, which are asked again rather than kept; a null is as blank."""
    return F.when((F.size(values) == 1) & (F.get(values, F.lit(0)) != ""), F.get(values, F.lit(0)))


def each(page: Column, chosen: Column, read: Callable[[Column, Column], Column]) -> Column:
    """`read` of each chosen node and of the nodes within it, which are taken from the page once."""
    return F.transform(chosen, lambda n: with_value(inside(page, n), lambda own: read(n, own)))
