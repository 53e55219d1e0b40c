"""Nested JSON records to linked flat tables by vectorised structural indexing.

A batch of payloads is laid end to end in one byte array. Bitmaps of quotes, brackets and delimiters give, by prefix
sums, which bytes lie inside strings and how deep each bracket is. Every container then finds its parent, its key and
its place in a list by binary searches over the bracket positions of one depth; no recursive parse is made.

Results (one row for each object that is an attachment or an element of one of the lists ``items``,
``storage_refs``, ``variants``, ``transcription.segments`` and ``words``; and one of kind ``other`` for each non-null element of
any other list below an attachment, and for each element of those that is no object, so that nothing is lost):

* a null, empty or unreadable payload gives no row; an attachment that is null, a list or a number gives none;
* an attachment delivered as a JSON string counts as its object; an object in place of a list is its element 0;
* nulls in a list are no rows, but count in the places of those after them; an empty object is a row;
* of a key that occurs twice in one object the last value holds;
* objects below a row's object that are no list's element are fields of it by their path (``checks.md5``), however deep;
* an element that is no object has its text as the field ``value``; a list within a list is a list of its element;
* payloads may be nested to any depth: nothing here is recursive.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Key of the parent object -> kind of the elements of the list below it.
LISTS = {"items": "attachment", "storage_refs": "storage_ref", "variants": "variant", "segments": "segment", "words": "word"}
#: Which lists are looked for in which kind of object.
CHILDREN = {
    "attachment": ("items", "storage_refs"),
    "storage_ref": ("variants",),
    "transcription": ("segments",),
    "segment": ("words",),
}
NODES = "record_id bigint, kind string, node_path string, parent_path string, place int, fields map<string,string>"
_ARROW = pa.schema(
    [
        ("record_id", pa.int64()),
        ("kind", pa.string()),
        ("node_path", pa.string()),
        ("parent_path", pa.string()),
        ("place", pa.int32()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)
_BATCH_BYTES = 8 << 20
#: What a JSON text may hold besides brackets, and what may follow what (see ``_valid``).
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))')


class StructuralIndex:
    """Containers and members of readable JSON texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        b = np.frombuffer(self.raw, dtype=np.uint8)
        n = len(b)
        # A quote after an odd run of backslashes is part of a string.
        at = np.arange(n, dtype=np.int64)
        plain = np.maximum.accumulate(np.where(b != 92, at, -1)) if n else at
        quote = b == 34
        if n > 1:
            run = at[:-1] - plain[:-1]
            quote[1:] &= (run & 1) == 0
        self.quotes = np.flatnonzero(quote)
        inside = (np.cumsum(quote) & 1).astype(bool)
        opens = ((b == 123) | (b == 91)) & ~inside
        closes = ((b == 125) | (b == 93)) & ~inside
        marks = opens | closes | (((b == 58) | (b == 44)) & ~inside)
        self.token = np.flatnonzero(marks)
        what = b[self.token]
        is_open, is_close = opens[self.token], closes[self.token]
        depth = np.cumsum(is_open.astype(np.int32) - is_close.astype(np.int32))
        #: Depth of the container a token stands in (for a bracket: that it belongs to itself).
        level = np.where(is_close, depth + 1, depth)
        self.token_level = level
        self.start = self.token[is_open]
        self.is_list = what[is_open] == 91
        self.level = level[is_open]
        number_of_open = np.cumsum(is_open) - 1
        k = len(self.start)
        self.parent = np.full(k, -1, dtype=np.int64)
        self.place = np.zeros(k, dtype=np.int64)
        colon = (what == 58) & ~is_open
        self.end, self.commas = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        members, owners = [], []
        # Tokens and containers by depth: each depth is looked at once, however many there are.
        deepest = int(self.level.max(initial=0))
        by_level, containers = np.argsort(level, kind="stable"), np.argsort(self.level, kind="stable")
        token_from = np.searchsorted(level[by_level], np.arange(deepest + 2))
        from_ = np.searchsorted(self.level[containers], np.arange(deepest + 3))
        for d in range(1, deepest + 1):
            own, below = containers[from_[d] : from_[d + 1]], containers[from_[d + 1] : from_[d + 2]]
            tokens = by_level[token_from[d] : token_from[d + 1]]
            self.end[own] = self.token[tokens[is_close[tokens]]]
            comma_at = self.token[tokens[what[tokens] == 44]]
            self.commas[own] = np.bincount(np.searchsorted(self.start[own], comma_at) - 1, minlength=len(own))
            colons = tokens[colon[tokens]]
            members.append(colons)
            owners.append(own[np.searchsorted(self.start[own], self.token[colons]) - 1])
            if len(below):
                up = own[np.searchsorted(self.start[own], self.start[below]) - 1]
                self.parent[below] = up
                self.place[below] = np.searchsorted(comma_at, self.start[below]) - np.searchsorted(comma_at, self.start[up])
        member = np.concatenate(members) if members else np.empty(0, dtype=np.int64)
        owner = np.concatenate(owners) if owners else np.empty(0, dtype=np.int64)
        order = np.argsort(member)
        member, self.owner = member[order], owner[order]
        colon_at = self.token[member]
        q = np.searchsorted(self.quotes, colon_at)
        self.key_from, self.key_to = self.quotes[q - 2] + 1, self.quotes[q - 1]
        after = member + 1
        self.value_from, self.value_to = colon_at + 1, self.token[after] if len(member) else colon_at
        opened = is_open[after] if len(member) else np.empty(0, dtype=bool)
        self.value_node = np.where(opened, number_of_open[after] if len(member) else 0, -1)
        #: First container of each text that has one.
        ends = np.cumsum([len(t) + 1 for t in texts])
        tops = np.flatnonzero(self.level == 1)
        self.top = np.full(len(texts), -1, dtype=np.int64)
        self.top[np.searchsorted(ends, self.start[tops], side="right")] = tops
        self.first_member = np.searchsorted(self._by_owner(), np.arange(k))
        self.last_member = np.searchsorted(self._by_owner(), np.arange(k), side="right")
        below = np.argsort(self.parent, kind="stable")
        self._below, sorted_parent = below, self.parent[below]
        self._below_from = np.searchsorted(sorted_parent, np.arange(k))
        self._below_to = np.searchsorted(sorted_parent, np.arange(k), side="right")

    def _by_owner(self) -> np.ndarray:
        if not hasattr(self, "_member_order"):
            self._member_order = np.argsort(self.owner, kind="stable")
            self._sorted_owner = self.owner[self._member_order]
        return self._sorted_owner

    def members(self, node: int) -> dict[str, int]:
        """Key -> number of its member; the last of equal keys."""
        out = {}
        for m in self._member_order[self.first_member[node] : self.last_member[node]].tolist():
            key = self.raw[self.key_from[m] : self.key_to[m]]
            out[json.loads(b'"' + key + b'"') if b"\\" in key else key.decode()] = m
        return out

    def scalar(self, member: int) -> str | None:
        """Text of a member that is no container; null for null."""
        text = self.raw[self.value_from[member] : self.value_to[member]].strip()
        if text[:1] == b'"':
            return json.loads(text) if b"\\" in text else text[1:-1].decode()
        return None if text == b"null" else text.decode()

    def scalars(self, node: int) -> list[tuple[int, str]]:
        """(place, text) of the elements of a list that are neither containers nor null."""
        if not self.is_list[node] or self.commas[node] + 1 == self._below_to[node] - self._below_from[node]:
            return []
        a, b = np.searchsorted(self.token, (self.start[node], self.end[node]))
        own = a + np.flatnonzero(self.token_level[a : b + 1] == self.level[node])
        out = []
        for i, (x, y) in enumerate(zip(self.token[own[:-1]].tolist(), self.token[own[1:]].tolist(), strict=True)):
            text = self.raw[x + 1 : y].strip()
            if text and text != b"null" and text[:1] not in (b"{", b"["):
                out.append((i, json.loads(text) if text[:1] == b'"' else text.decode()))
        return out

    def elements(self, node: int) -> list[tuple[int, int]]:
        """(place, container) of the containers of a list; an object counts as a list of itself."""
        if not self.is_list[node]:
            return [(0, node)]
        below = self._below[self._below_from[node] : self._below_to[node]]
        return list(zip(self.place[below].tolist(), below.tolist(), strict=True))


def _valid(text: str) -> bool:
    """Whether a text is JSON, by a stack of its own: for texts too deeply nested for the library's parser."""
    stack: list[str] = []
    state, at = "value", 0  # value, first (value or end of a list), key, first key (or end of an object), colon, after
    while m := _TOKEN.match(text, at):
        at = m.end()
        sign, string = m[1], m[2]
        if state in ("value", "first") and (sign in ("[", "{") or sign is None):
            if sign is None:
                state = "after"
            else:
                stack.append("]" if sign == "[" else "}")
                state = "first" if sign == "[" else "first key"
        elif state in ("key", "first key") and string is not None:
            state = "colon"
        elif state == "colon" and sign == ":":
            state = "value"
        elif state == "after" and sign == "," and stack:
            state = "value" if stack[-1] == "]" else "key"
        elif sign in ("]", "}") and state in ("after", "first" if sign == "]" else "first key") and stack and stack[-1] == sign:
            stack.pop()
            state = "after"
        else:
            return False
    return state == "after" and not stack and not text[at:].strip(" \t\n\r")


def readable(text: str | None) -> bool:
    """Whether a payload is JSON as a whole: the exact check of what the index may be built over."""
    if not text:
        return False
    try:
        json.loads(text)
        return True
    except RecursionError:
        return _valid(text)
    except ValueError:
        return False


def nodes_of(payloads: list[tuple[int, str]]) -> list[tuple]:
    """Rows of NODES of (record_id, payload)."""
    rows: list[tuple] = []
    #: record, text, where it hangs: None for a payload, else (path, parent, place) of the attachment that it is.
    todo: list[tuple[int, bytes, tuple | None]] = [(i, p.encode("utf-8", "surrogatepass"), None) for i, p in payloads if readable(p)]
    while todo:
        index = StructuralIndex([t for _, t, _ in todo])
        inner: list[tuple[int, bytes, tuple | None]] = []
        for k, (record, _, at) in enumerate(todo):
            top = int(index.top[k])
            if top < 0 or index.is_list[top]:
                continue
            if at is not None:
                _walk(index, record, "attachment", top, *at, rows, inner)
                continue
            member = index.members(top).get("attachment")
            if member is not None:
                _attachment(index, record, member, ("attachment", None, 0), rows, inner)
        todo = inner
    return rows


def _attachment(index: StructuralIndex, record: int, member: int, at: tuple, rows: list, inner: list) -> None:
    """An attachment as a member's value: an object, or a string that holds one."""
    node = int(index.value_node[member])
    if node >= 0:
        if not index.is_list[node]:
            _walk(index, record, "attachment", node, *at, rows, inner)
        return
    text = index.raw[index.value_from[member] : index.value_to[member]].strip()
    if text[:1] == b'"' and readable(held := json.loads(text)):
        inner.append((record, held.encode("utf-8", "surrogatepass"), at))


def _walk(index: StructuralIndex, record: int, kind: str, node: int, path: str, parent: str | None, place: int, rows: list, inner: list) -> None:
    stack = [(kind, node, path, parent, place)]
    while stack:
        kind, node, path, parent, place = stack.pop()
        fields: dict[str, str] = {}
        lists: list[tuple[str, str, int]] = []  # kind of the elements, path, container
        if index.is_list[node]:
            lists.append(("other", path, node))
        else:
            named = CHILDREN.get(kind, ())
            #: Objects of this row: (container, its place in this list's parent, its key); a path is joined only where something has it.
            inside: list[tuple[int, int, str]] = [(node, -1, "")]
            for at, (container, _, _) in enumerate(inside):
                prefix: str | None = None
                for key, m in index.members(container).items():
                    below = int(index.value_node[m])
                    if below >= 0 and at == 0 and key in named:
                        lists.append((LISTS[key], f"{path}.{key}", below))
                        continue
                    if below >= 0 and at and kind == "attachment" and key in CHILDREN["transcription"] and inside[at][1:] == (0, "transcription"):
                        lists.append((LISTS[key], f"{path}.transcription.{key}", below))
                        continue
                    if below >= 0 and not index.is_list[below]:
                        inside.append((below, at, key))
                        continue
                    if prefix is None:
                        prefix = _prefix(inside, at)
                    if below >= 0:
                        lists.append(("other", f"{path}.{prefix}{key}", below))
                    elif (value := index.scalar(m)) is not None:
                        fields[prefix + key] = value
        rows.append((record, kind, path, parent, place, list(fields.items())))
        for what, where, held in lists:
            for i, text in index.scalars(held):
                rows.append((record, "other", f"{where}[{i}]", path, i, [("value", text)]))
            for i, child in index.elements(held):
                stack.append(("other" if index.is_list[child] else what, child, f"{where}[{i}]", path, i))


def _prefix(inside: list[tuple[int, int, str]], at: int) -> str:
    keys = []
    while at:
        _, up, key = inside[at]
        keys.append(key)
        at = up
    return "".join(f"{k}." for k in reversed(keys))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        part, size = [], 0
        for i, t in zip(ids, texts, strict=True):
            if t:
                part.append((i, t))
                size += len(t)
            if size > _BATCH_BYTES:
                yield _rows(part)
                part, size = [], 0
        if part:
            yield _rows(part)


def _rows(part: list[tuple[int, str]]) -> pa.RecordBatch:
    rows = nodes_of(part)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def nodes(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """All nodes of ``payload`` as rows of NODES: each names its place and, in ``parent_path``, its parent."""
    return records.select(F.col(key).cast("bigint").alias("record_id"), F.col(payload).alias("payload")).where("payload is not null").mapInArrow(_batches, NODES)


def _field(name: str):
    return F.col("fields").getItem(name)


def _table(all_nodes: DataFrame, kind: str, **columns) -> DataFrame:
    return all_nodes.where(F.col("kind") == kind).select("record_id", "node_path", "parent_path", "place", *[c.alias(n) for n, c in columns.items()])


def attachments(all_nodes: DataFrame) -> DataFrame:
    """One row for each attachment, top or nested in ``items``; numbers given as strings are read, others are null."""
    return _table(
        all_nodes,
        "attachment",
        type=_field("type"),
        transcription_status=_field("transcription.status"),
        transcription_language=F.coalesce(_field("transcription.language.code"), _field("transcription.language")),
        transcription_language_probability=_field("transcription.language.probability").try_cast("double"),
    )


def storage_refs(all_nodes: DataFrame) -> DataFrame:
    """One row for each storage ref; ``parent_path`` is its attachment."""
    return _table(all_nodes, "storage_ref", bucket=_field("bucket"), object=_field("object"), md5=_field("checks.md5"), bytes=_field("checks.bytes").try_cast("bigint"))


def variants(all_nodes: DataFrame) -> DataFrame:
    """One row for each variant; ``parent_path`` is its storage ref."""
    return _table(all_nodes, "variant", bucket=_field("bucket"), object=_field("object"), width=_field("size.w").try_cast("bigint"), height=_field("size.h").try_cast("bigint"))


def segments(all_nodes: DataFrame) -> DataFrame:
    """One row for each transcription segment; ``parent_path`` is its attachment."""
    return _table(all_nodes, "segment", start=_field("start").try_cast("double"), text=_field("text"))


def words(all_nodes: DataFrame) -> DataFrame:
    """One row for each word; ``parent_path`` is its segment."""
    return _table(all_nodes, "word", w=_field("w"), p=_field("p").try_cast("double"))


def others(all_nodes: DataFrame) -> DataFrame:
    """One row for each element of any other list: its text, or null and its fields where it is an object."""
    return _table(all_nodes, "other", value=_field("value"), fields=F.col("fields"))


def message_refs(messages: DataFrame) -> DataFrame:
    """Refs of the attachment column of messages, one row for each non-null ref of a message, with its place."""
    return (
        messages.where("size(attachment.storage_refs) > 0")
        .select(F.col("id").alias("message_id"), F.posexplode("attachment.storage_refs").alias("place", "ref"))
        .where("ref is not null")
        .select("message_id", "place", F.col("ref.bucket").alias("bucket"), F.col("ref.object").alias("object"))
        .distinct()
    )
