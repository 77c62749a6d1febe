"""Whole-array scan of large, regular documents.

Markup positions, names, nesting, lines and ends come out of array operations over
the bytes, tens of times faster than lexeme by lexeme. Anything these operations
cannot vouch for (a fault of any kind, '>' in text or values, single-quoted
attributes, a document type, very deep nesting) makes ``vector_scan`` return None,
and the scanner in ``scanner.py`` decides; where there is a result, it is the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from tessera.operators.scanner import NO_PARENT, Index

#: Below this size the array operations do not pay.
MIN_BYTES = 8 << 10
_MAX_DEPTH, _MAX_NAMES, _NAME_WORDS = 200, 256, 4
_NAME = rb"[A-Za-z_:\x80-\xff][A-Za-z0-9_:.\-\x80-\xff]*"
_SHAPE = re.compile(rb"<" + _NAME + rb"(?:[ \t\r\n]+" + _NAME + rb"[ \t\r\n]*=[ \t\r\n]*\")+[ \t\r\n]*/?>")
_SHAPE_NAME = re.compile(rb"(" + _NAME + rb")[ \t\r\n]*=")
_VALUE = re.compile(rb'"[^"]*"')
_REFERENCE = re.compile(rb"&(?:#x[0-9a-fA-F]{1,29}|#[0-9]{1,30}|[A-Za-z_:][A-Za-z0-9_:.\-]{0,31});")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
_IS_NAME = np.array([chr(b).isalnum() and b < 128 or b in b"_:.-" or b >= 128 for b in range(256)])
_IS_START = _IS_NAME.copy()
_IS_START[[*b"0123456789.-"]] = False
#: Masks that keep the first n bytes of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _skipped(content: bytes, at: list[int]) -> list[tuple[int, int]] | None:
    """Extents of comments, CDATA sections and processing instructions that open at ``at``; None if one is irregular."""
    out, done = [], -1
    for i in at:
        if i < done:
            continue  # inside the one before
        if content.startswith(b"<!--", i):
            end = content.find(b"-->", i + 4)
            if end < 0 or content.find(b"--", i + 4, end) >= 0 or end > i + 4 and content[end - 1] == 45:
                return None
            done = end + 3
        elif content.startswith(b"<![CDATA[", i):
            end = content.find(b"]]>", i + 9)
            done = end + 3
        elif content[i + 1] == 63:
            end = content.find(b"?>", i + 2)
            done = end + 2
        else:
            return None
        if end < 0:
            return None
        out.append((i, done))
    return out


def _name_ids(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[int]] | None:
    """An id for each name, numbered by first appearance, and the positions of first appearances."""
    size = end - start
    words = int(size.max() + 7) // 8 if len(size) else 1
    if words > _NAME_WORDS:
        return None
    padded = np.concatenate([a, np.zeros(8 * words, np.uint8)])
    loaded = np.ndarray(len(a) + 1, "<u8", padded, 0, (1,))  # eight bytes from every position
    keys = []
    mixed = size.astype(np.uint64)
    for w in range(words):
        left = np.clip(size - 8 * w, 0, 8)
        part = loaded[np.minimum(start + 8 * w, len(a))] & _KEEP[left]
        keys.append(part)
        mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    distinct, ids = np.unique(mixed, return_inverse=True)
    if len(distinct) > _MAX_NAMES:
        return None
    seen = np.empty(len(distinct), np.int64)
    seen[ids[::-1]] = np.arange(len(ids))[::-1]  # the last assignment is the first appearance
    order = np.argsort(seen)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    ids, first = number[ids], seen[order].tolist()
    lead = np.array(first, np.int64)[ids]
    if (size != size[lead]).any() or any((k != k[lead]).any() for k in keys):
        return None  # two names with one mix
    return ids, first


@dataclass
class Structure:
    """Tags of one or more documents laid end to end: positions, names, nesting, and attributes of each tag."""

    lt: np.ndarray
    gt: np.ndarray
    document: np.ndarray
    start: np.ndarray
    name_end: np.ndarray
    opens: np.ndarray
    depth_of: np.ndarray
    attributes: np.ndarray
    names: tuple[np.ndarray, list[int]]
    heads: np.ndarray
    tails: np.ndarray
    newlines: np.ndarray


def _structure(content: bytes, bounds: np.ndarray) -> Structure | None:
    """``bounds`` are the ends of the documents. None unless every one of them is regular."""
    if not content or b"]]>" in content and b"<![CDATA[" not in content:
        return None
    of = lambda x: np.searchsorted(bounds, x, side="right")
    a = np.frombuffer(content, np.uint8)
    lt, gt = np.flatnonzero(a == 60), np.flatnonzero(a == 62)
    if not len(lt) or lt[-1] + 2 >= len(a):
        return None
    kind = a[lt + 1]
    special = lt[(kind == 33) | (kind == 63)]
    if len(special):
        spans = _skipped(content, special.tolist())
        if spans is None:
            return None
        lows, highs = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
        if (of(lows) != of(highs - 1)).any():
            return None
        outside = lambda x: x[x >= np.concatenate([[0], highs])[np.searchsorted(lows, x, side="right")]]
        lt, gt = outside(lt), outside(gt)
        if not len(lt):
            return None
        kind = a[lt + 1]
        if b"]]>" in content and content.count(b"]]>") != sum(content.startswith(b"<![CDATA[", s) for s, _ in spans):
            return None
    else:
        lows = highs = np.zeros(0, np.int64)
        outside = lambda x: x
    if len(lt) != len(gt) or not ((lt < gt).all() and (gt[:-1] < lt[1:]).all()) or len(lows) and (np.searchsorted(lows, lt) != np.searchsorted(lows, gt)).any():
        return None
    document = of(lt)
    if (document != of(gt)).any() or (np.bincount(document, minlength=len(bounds)) == 0).any():
        return None
    if b"&" in content:
        amp = outside(np.flatnonzero(a == 38))
        found = np.array([m.span() for m in _REFERENCE.finditer(content)], np.int64).reshape(-1, 2)
        found = found[of(found[:, 0]) == of(found[:, 1] - 1), 0]
        if not np.isin(amp, found, assume_unique=True).all():
            return None

    closing = kind == 47
    start = lt + 1 + closing
    breaks = np.flatnonzero(~_IS_NAME[a])  # every tag has one: its '>'
    name_end = breaks[np.searchsorted(breaks, start)]
    if not _IS_START[a[start]].all() or (name_end == start).any():
        return None
    empty = (a[gt - 1] == 47) & ~closing
    # after the name of an end tag only white space, of a start tag nothing, white space or attributes
    rest = gt - empty > name_end
    odd = np.flatnonzero(rest)
    attributes = np.zeros(len(lt), np.int64)
    if len(odd):
        late = odd[closing[odd]]
        for i, j in zip(name_end[late].tolist(), gt[late].tolist()):
            if content[i:j].strip(b" \t\r\n"):
                return None
        early = odd[~closing[odd]]
        joined = b"".join([content[i:j] for i, j in zip(lt[early].tolist(), (gt[early] + 1).tolist())])
        if b"'" in joined:
            return None
        shapes = _VALUE.sub(b'"', joined).split(b"<")[1:]
        n_of = dict.fromkeys(shapes, 0)
        for shape in n_of:
            names = _SHAPE_NAME.findall(shape)
            if not names:
                if not re.fullmatch(_NAME + rb"[ \t\r\n]*/?>", shape):
                    return None
                continue
            if not _SHAPE.fullmatch(b"<" + shape) or len(set(names)) != len(names) or len(names) > 64 or shape.count(b'"') != len(names):
                return None
            n_of[shape] = len(names)
        attributes[early] = np.fromiter(map(n_of.__getitem__, shapes), np.int64, len(shapes))

    step = np.where(closing, -1, np.where(empty, 0, 1))
    level = np.cumsum(step)
    opens = ~closing
    depth_of = level - (step == 1)  # depth of the element that a tag opens or closes
    last = np.flatnonzero(np.diff(document, append=len(bounds)))  # the last tag of each document
    first = np.concatenate([[0], last[:-1] + 1])
    if (level[last] != 0).any() or (level < 0).any() or int(depth_of.max()) >= _MAX_DEPTH:
        return None
    if (np.bincount(document[opens & (depth_of == 0)], minlength=len(bounds)) != 1).any() or closing[first].any():
        return None
    # outside the roots there is only white space
    starts = np.concatenate([[0], bounds[:-1]])
    edge = np.zeros(len(a) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, lt[first], -1)
    np.add.at(edge, gt[last] + 1, 1)
    np.add.at(edge, bounds, -1)
    around = outside(np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8)))
    if content.startswith(b"\xef\xbb\xbf"):
        around = around[3:]
    if not _WHITE[a[around]].all():
        return None

    names = _name_ids(a, start, name_end)
    if names is None:
        return None
    ids = names[0]
    # the k-th start and the k-th end at a depth belong together
    paired = np.flatnonzero(closing | (opens & ~empty))
    order = paired[np.argsort(depth_of[paired].astype(np.uint16), kind="stable")]
    heads, tails = order[::2], order[1::2]
    if len(heads) != len(tails) or closing[heads].any() or not closing[tails].all() or (ids[heads] != ids[tails]).any():
        return None

    return Structure(lt, gt, document, start, name_end, opens, depth_of, attributes, names, heads, tails, np.flatnonzero(a == 10))


def vector_totals(contents: list[bytes]) -> list[tuple[int, int, int, int, int]] | None:
    """Bytes, lines, elements, attributes and depth of documents that are all regular, or None."""
    bounds = np.cumsum([len(c) for c in contents])
    if not len(bounds) or (found := _structure(b"".join(contents), bounds)) is None:
        return None
    n, at = len(bounds), np.flatnonzero(found.opens)
    elements = np.bincount(found.document[at], minlength=n)
    attributes = np.bincount(found.document, found.attributes, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(found.document)) + 1])
    depth = np.maximum.reduceat(found.depth_of, first) + 1
    lines = np.bincount(np.searchsorted(bounds, found.newlines, side="right"), minlength=n) + 1
    return list(zip(map(len, contents), lines.tolist(), elements.tolist(), attributes.tolist(), depth.tolist()))


def vector_scan(content: bytes, stride: int = 32) -> Index | None:
    """The index of a well-formed document (without contents), or None."""
    found = _structure(content, np.array([len(content)]))
    if found is None:
        return None
    depth_of, gt, newlines = found.depth_of, found.gt, found.newlines
    deepest = int(depth_of.max())
    at = np.flatnonzero(found.opens)
    index = Index(stride=stride, total_elements=len(at), total_attributes=int(found.attributes.sum()), max_depth=deepest + 1, line_count=len(newlines) + 1, file_len=len(content))
    end_of = gt + 1
    end_of[found.heads] = gt[found.tails] + 1
    depth = depth_of[at]
    parent = np.full(len(at), NO_PARENT)
    above = np.flatnonzero(depth == 0)
    for d in range(1, deepest + 1):
        own = np.flatnonzero(depth == d)
        parent[own] = above[np.searchsorted(above, own) - 1]
        above = own
    ids, leads = found.names
    index.start, index.end, index.parent, index.depth = found.lt[at].tolist(), end_of[at].tolist(), parent.tolist(), depth.tolist()
    index.line = (np.searchsorted(newlines, found.name_end[at], side="right") + 1).tolist()
    index.name = ids[at].tolist()
    index.names = [content[found.start[k] : found.name_end[k]] for k in leads]
    index.checkpoints = [0, *(newlines[stride - 1 :: stride] + 1).tolist()]
    return index
