"""Plain pages as columns: the tags, values and texts of many pages at once, found in their bytes by numpy and Arrow.

A page is plain if its tags are whole, its values quoted or bare, and each end tag is that of the element opened last; all other pages
are named in `torn`, for a reader that takes them one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a tag is by what it says without its values.
TORN, OPENS, STANDS, ENDS, REMARK = range(5)
_NAME = np.zeros(256, bool)
_NAME[[*b"#0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
#: Letters of a character reference that are looked at; none is longer.
_REFERENCE = 33


def _strings(offsets: np.ndarray, data: pa.Buffer) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), data)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of all the numbers from each lo to before its hi."""
    counts = hi - lo
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return offsets, np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], counts)


class Form:
    """A tag without what stands in its quotes: `kind`, the element's `name`, whether its content is `raw`, and for each attribute the
    number of its value among the quoted ones, or its text."""

    def __init__(self, kind: int, name: str = "", raw: bool = False, attrs: dict[str, int | str] | None = None):
        self.kind, self.name, self.raw, self.attrs = kind, name, raw, attrs or {}


class Tokens:
    """The tokens of some pages in order: tags and comments, which are also numbered by themselves, and the texts between them."""

    def __init__(self, pages: pa.StringArray, form: Callable[[str], Form]):
        ends = np.frombuffer(pages.buffers()[1], np.int32)[pages.offset : pages.offset + len(pages) + 1]
        buffer = (pages.buffers()[2] or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0]))
        self.pages, self.buffer, self.size = ends.astype(np.int64) - ends[0], buffer, int(ends[-1] - ends[0])
        self.data = np.concatenate((np.frombuffer(buffer, np.uint8), np.zeros(8, np.uint8)))
        self.torn = np.zeros(len(pages), bool)
        data = self.data[: self.size]
        self.marks = np.flatnonzero((data == 60) | (data == 62) | (data == 34) | (data == 39) | (data == 38) | (data == 0))
        self.mark = data[self.marks]
        self._tear(self.marks[self.mark == 0])
        self._tags()
        self._values()
        self._forms(form)
        self._nest()
        self._texts()

    def _tear(self, at: np.ndarray) -> None:
        """The pages with these places are torn."""
        if len(at):
            self.torn[np.searchsorted(self.pages, at, "right") - 1] = True

    def _remarks(self, lt: np.ndarray, gt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of < and > without those in comments, which have no hyphen within. What only looks like one tears its page."""
        data = self.data
        some = lt[data[lt + 1] == 33]
        if not len(some):
            self.comments = some
            return lt, gt
        dash = np.append(np.flatnonzero(data == 45), len(data) - 3)
        last = dash[np.searchsorted(dash, some + 5)]
        whole = (data[some + 2] == 45) & (data[some + 3] == 45) & (data[some + 4] == 32) & (data[last + 1] == 45) & (data[last + 2] == 62)
        whole &= np.searchsorted(self.pages, some, "right") == np.searchsorted(self.pages, last + 2, "right")
        self.comments, end = some[whole], last[whole] + 2
        held = lambda at: np.searchsorted(self.comments, at, "left") > np.searchsorted(end, at, "left")  # noqa: E731  begun before and not yet over
        inner = lambda at: held(at) & ~np.isin(at, end)
        self._tear(some[~whole & ~held(some)])
        return lt[~inner(lt)], gt[~inner(gt)]

    def _tags(self) -> None:
        pages = self.pages
        lt, gt = self._remarks(self.marks[self.mark == 60], self.marks[self.mark == 62])
        if len(lt) != len(gt) or not ((lt < gt).all() and (gt[:-1] < lt[1:]).all()):
            gt = np.append(gt, len(self.data))[np.searchsorted(gt, lt)]
        of = np.repeat(np.arange(len(self.torn)), np.diff(np.searchsorted(lt, pages)))
        self._tear(lt[(gt >= np.append(lt[1:], self.size)) | (gt >= pages[of + 1])])
        whole = ~self.torn[of]
        self.starts, self.ends, self.of = lt[whole], gt[whole] + 1, of[whole]
        edges = np.column_stack((self.starts, self.ends)).ravel()
        edges = edges[np.append(edges[:-1] < edges[1:], True)] if len(edges) else edges
        more = np.unique(pages)
        place = np.searchsorted(edges, more)
        new = np.append(edges, -1)[place] != more
        self.bounds = np.insert(edges, place[new], more[new]) if self.size else edges
        self.token = np.searchsorted(self.bounds, self.starts)
        self.is_tag = np.zeros(max(len(self.bounds) - 1, 0), bool)
        self.is_tag[self.token] = True
        self.tags_before = np.concatenate(([0], np.cumsum(self.is_tag)))
        self.page_token = np.searchsorted(self.bounds, pages)
        self.all = _strings(self.bounds, self.buffer) if len(self.bounds) else pa.array([], pa.string())
        self.comment = np.isin(self.starts, self.comments) if len(self.comments) else np.zeros(len(self.starts), bool)

    def _values(self) -> None:
        """What stands in quotes: the quote of one kind that comes first opens a value, the next of its kind closes it."""
        quote = (self.mark == 34) | (self.mark == 39)
        at, kind = self.marks[quote], self.mark[quote]
        tag = np.searchsorted(self.starts, at) - 1
        held = (tag >= 0) & (at < np.append(self.ends, 0)[tag]) & ~np.append(self.comment, False)[tag]
        at, tag, kind = at[held], tag[held], kind[held]
        counts = np.bincount(tag, minlength=len(self.starts))
        end = np.cumsum(counts)
        now = end - counts
        after = np.full(len(at), len(at))
        for one in (34, 39):
            same = np.flatnonzero(kind == one)
            after[same[:-1]] = same[1:]
        opens = np.zeros(len(at), bool)
        while True:
            some = np.flatnonzero(now < end)
            if not len(some):
                break
            now, end = now[some], end[some]
            close = after[now]
            if (close >= end).any():
                self._tear(at[now[close >= end]])
                now, end, close = now[close < end], end[close < end], close[close < end]
            opens[now] = True
            now = close + 1
        first = np.flatnonzero(opens)
        self.value_tag, self.value_start, self.value_end = tag[first], at[first] + 1, at[after[first]]
        self.value_count = np.bincount(self.value_tag, minlength=len(self.starts))
        self.first_value = np.cumsum(self.value_count) - self.value_count

    def _forms(self, form: Callable[[str], Form]) -> None:
        """Tags are of one form if the pieces around their values are the same, which makes the pieces' numbers the digits of another."""
        size, count = len(self.starts), self.value_count
        if not size:
            self.forms, self.form, self.kind = [], np.zeros(0, np.int64), np.zeros(0, np.int8)
            return
        first = self.first_value + np.arange(size)
        cuts = np.empty(2 * (size + len(self.value_tag)), np.int64)
        piece = np.arange(len(self.value_tag)) + self.value_tag
        cuts[2 * first], cuts[2 * (first + count) + 1] = self.starts, self.ends
        cuts[2 * piece + 1], cuts[2 * piece + 2] = self.value_start, self.value_end
        inside = np.flatnonzero(self.comment)
        cuts[2 * first[inside] + 1] = self.starts[inside] + 1
        found = _strings(cuts, self.buffer).take(pa.array(np.arange(0, len(cuts), 2))).dictionary_encode()
        digit, base = found.indices.to_numpy().astype(np.int64) + 1, len(found.dictionary) + 1
        key = digit[first]
        for j in range(1, int(count.max()) + 1):
            some = np.flatnonzero(count >= j)
            if int(key.max()) > (1 << 62) // base:
                key = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64) + 1 + (j << 40)
            key[some] = key[some] * base + digit[first[some] + j]
        found = pa.array(key).dictionary_encode().indices.to_numpy()
        of = np.zeros(int(found.max()) + 1, np.int64)
        of[found] = np.arange(size)
        written = lambda i: "<>" if self.comment[i] else b"".join(self.data[cuts[2 * j] : cuts[2 * j + 1]].tobytes() for j in range(first[i], first[i] + count[i] + 1)).decode()
        self.forms, self.form = [form(written(i)) for i in of.tolist()], found
        self.kind = self.by_form(lambda f: f.kind, np.int8)
        self.kind[self.comment] = REMARK

    def by_form(self, of: Callable[[Form], int], kind: type = np.int64) -> np.ndarray:
        """A number for each tag that its form tells."""
        return np.array([of(f) for f in self.forms], kind).take(self.form)

    def _nest(self) -> None:
        """`last` is the tag that ends the element which a tag begins, `depth` how many elements are open around it."""
        first, of = np.searchsorted(self.starts, self.pages), self.of
        self.torn[of[self.kind == TORN]] = True
        step = (self.kind == OPENS).astype(np.int64) - (self.kind == ENDS)
        step[self.torn[of]] = 0
        below = np.concatenate(([0], np.cumsum(step)))
        base = below[first[:-1]]
        self.torn |= below[first[1:]] != base
        self.torn[of[below[1:] < base[of]]] = True
        self.kind[self.torn[of]] = TORN
        step[self.torn[of]] = 0
        self.after = np.cumsum(step)
        self.depth = self.after - (step > 0)
        self.last = np.arange(len(step))
        moves = np.flatnonzero(step)
        depth = self.depth[moves]
        order = moves[np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 1 << 15 else depth, kind="stable")]
        begin, end = order[0::2], order[1::2]
        self.last[begin] = end
        names = {name: i for i, name in enumerate({f.name for f in self.forms})}
        name = self.by_form(lambda f: names[f.name])
        raw = self.by_form(lambda f: f.raw and f.kind == OPENS, bool)
        wrong = (name[begin] != name[end]) | (raw[begin] & (end != begin + 1))
        self.torn[of[begin[wrong]]] = True

    def _changed(self) -> np.ndarray:
        """The places of & that begin a character reference."""
        at = self.marks[self.mark == 38]
        if not len(at):
            return at
        end, going = at + 1, np.arange(len(at))
        for _ in range(_REFERENCE):
            going = going[_NAME[self.data[end[going]]]]
            if not len(going):
                break
            end[going] += 1
        end += self.data[end] == 59
        found = _strings(np.column_stack((at, end)).ravel(), self.buffer).take(pa.array(np.arange(0, 2 * len(at), 2))).dictionary_encode()
        return at[np.array([unescape(x) != x for x in found.dictionary.to_pylist()], bool)[found.indices.to_numpy()]]

    def _texts(self) -> None:
        """`scripts` are the tokens that stand in scripts and styles, `texts` what the other texts say on one line, of those that say anything."""
        tokens = np.flatnonzero(~self.is_tag)
        left = self.tags_before[tokens] - 1
        script = np.zeros(len(tokens), bool)
        if len(self.starts):
            script = (left >= 0) & self.by_form(lambda f: f.kind == OPENS and f.name in ("script", "style"), bool)[left] & (self.kind[left] == OPENS)
        self.scripts, self.script_tag, plain, left = tokens[script], left[script], tokens[~script], left[~script]
        self.text_depth = np.where(left >= 0, self.after[left], 0) if len(self.starts) else np.zeros(len(plain), np.int64)
        self.texts = self.all.take(pa.array(plain))
        changed = self._changed()
        self.odd_values = np.zeros(len(self.value_tag), bool)
        if len(changed):
            at = np.searchsorted(self.value_start, changed, "right") - 1
            at, where = at[at >= 0], changed[at >= 0]
            self.odd_values[at[where < self.value_end[at]]] = True
            odd = np.zeros(len(self.is_tag) + 1, bool)
            odd[np.searchsorted(self.bounds, changed, "right") - 1] = True
            odd = odd[plain]
            self.texts = pc.replace_with_mask(self.texts, pa.array(odd), pa.array([unescape(x) for x in self.texts.filter(pa.array(odd)).to_pylist()], pa.string()))
        odd = pc.match_substring_regex(self.texts, r"[\t\n\r\x0B\f]|  ")
        if pc.any(odd).as_py():
            self.texts = pc.replace_with_mask(self.texts, odd, pc.replace_substring_regex(self.texts.filter(odd), r"[ \t\n\r\x0B\f]+", " "))
        self.texts = pc.utf8_trim(self.texts, " ")
        said = pc.greater(pc.binary_length(self.texts), 0)
        if not pc.all(said).as_py():
            self.texts, said = self.texts.filter(said), said.to_numpy(zero_copy_only=False).astype(bool)
            plain, self.text_depth = plain[said], self.text_depth[said]
        before = np.zeros(len(self.is_tag) + 1, bool)
        before[plain + 1] = True
        self.texts_before = np.cumsum(before)

    def attribute(self, name: str, tags: np.ndarray, unescaped: Callable[[str], str]) -> pa.StringArray:
        """The attribute of each of these tags, which ascend; null where there is none."""
        given = [f.attrs.get(name) for f in self.forms]
        fixed = [x for x in given if isinstance(x, str)]
        slot = np.array([-1 if x is None else -2 if isinstance(x, str) else x for x in given], np.int64)[self.form[tags]]
        quoted = slot >= 0
        value = self.first_value[tags[quoted]] + slot[quoted]
        pool = _strings(np.column_stack((self.value_start[value], self.value_end[value])).ravel(), self.buffer).take(pa.array(np.arange(0, 2 * len(value), 2))) if len(value) else pa.array([], pa.string())
        odd = self.odd_values[value]
        if odd.any():
            pool = pc.replace_with_mask(pool, pa.array(odd), pa.array([unescaped(x) for x in pool.filter(pa.array(odd)).to_pylist()], pa.string()))
        if quoted.all():
            return pool
        at = np.cumsum(quoted) - 1
        if fixed:
            pool = pa.concat_arrays([pool, pa.array(fixed, pa.string())])
            place = np.cumsum([isinstance(x, str) for x in given]) - 1 + len(value)
            at = np.where(slot == -2, place[self.form[tags]], at)
        return pool.take(pa.array(at, mask=slot == -1))
