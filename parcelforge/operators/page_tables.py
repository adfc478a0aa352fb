"""The rows of parcel tables, a batch of whole pages at a time: the rules of ``tables`` on arrays, with what hangs on a text alone worked out once for each text."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parcelforge.functions.text import ACCENTED, UNACCENTED
from parcelforge.operators import tables as t_

TOKEN = ("ord", "text", "x1", "y1", "x2", "y2")
#: Texts whose properties a task remembers, and pages that are laid out in arrays at once.
MOST_TEXTS, MOST_PAGES = 200_000, 2_000
_FOLD = str.maketrans(ACCENTED, UNACCENTED)
_ADDRESS_VETO = ("diện tích", "thời hạn", "mục đích", "đất bằng", "đất trồng")
_A = re.ASCII
_FOOT = re.compile("(" + "|".join(w.replace(" ", " ?") for w in t_.FOOTERS) + ")")
_DATE, _CELL, _GLUED, _SPLIT, _NUMBER = (re.compile(p, _A) for p in (t_.DATE, r"\d{1,4}[A-Za-z]?$", r"\d{4,}$", r"[\s/\-._]+", r"\d{1,4}$"))
NAMES = list(t_.COLUMNS)
KINDS = [k for k, _ in t_.HEADINGS]


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """The numbers of areas in cells and in pages; Python has no class of letters."""
    letters, start = [], None
    for point in range(0x110000):
        is_letter = unicodedata.category(chr(point))[0] == "L"
        if is_letter and start is None:
            start = point
        elif not is_letter and start is not None:
            letters.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    known = "".join(letters)
    return re.compile(t_.AREA_NUMBER.replace(r"\p{L}", known), _A), re.compile(rf"(?<![{known}\d])(\d{{2,4}}[.,]\d)(?![{known}\d])", _A)


def fold(text: str) -> str:
    low = text.lower().translate(_FOLD)
    return low if low.isascii() else "".join(c for c in low if unicodedata.category(c)[0] != "M")


def _stated(line: str) -> int:
    """As in ``tables.multi_parcel_pages``; -1 for none."""
    said = re.search("t[o0]ng(.*)$", line)
    if not said:
        return -1
    rest = re.sub(r"^\s*s[o06](?![a-z])", " ", said[1], flags=_A)
    number = re.match(r"\D{0,30}(\d{1,3})(?!\d)", rest, _A)
    meant = re.search("th[uaeoir]", re.match(r"\D*", rest, _A)[0]) or re.search(r"(?<![a-z])a[.)]?\s*t[o0]ng", line, _A)
    return int(number[1]) if number and meant else -1


def _properties(text: str | None) -> tuple:
    """trimmed, folded, blank, stated total, names an area, heading's kind, short number, heads an area column, heads another, footer, area, no address, no purpose, sheet and parcel, long number."""
    if text is None:
        return ("", "", True, -1, False, -1, False, False, False, False, np.nan, True, True, None, False)
    t = text.strip(" ")
    f = fold(t)
    kind = -1 if not f or any(w in f for w in t_.NO_HEADING) else next((i for i, (_, words) in enumerate(t_.HEADINGS) if any(w in f for w in words)), -1)
    kind = -1 if kind >= 0 and KINDS[kind] == "dia_chi" and ":" in f else kind
    dated = bool(_DATE.search(t))
    area = None if dated else _patterns()[0].search(t)
    parts = _SPLIT.split(t)
    pair = tuple(parts) if len(parts) == 2 and all(map(_NUMBER.match, parts)) else None
    low = t.lower()
    return (
        t, f, not t, _stated(f), "dien" in f, kind, bool(_CELL.match(t)), any(w in f for w in ("rieng", "chung", "dien tich")), any(w in f for w in ("muc dich", "thoi han", "nguon goc")), bool(_FOOT.match(re.sub(r"[.\s]+", " ", f, flags=_A) + " ")),
        float(area[1].replace(",", ".")) if area else np.nan, any(w in low for w in _ADDRESS_VETO), dated or "den ngay" in f, pair, bool(_GLUED.match(t)),
    )


def _page_totals(lines: list[str], stated: int) -> tuple[int, float | None]:
    """The number of parcels, 0 for a page that has no table, and the total area; as ``tables.multi_parcel_pages``."""
    text = "\n".join(lines)
    outline = any(re.search(rf"(?<![a-z]){letter}[.)]\s*{words}", text, _A) for letter, words in t_.OUTLINE)
    area = lambda lead: re.search(rf"{lead}dien\s*t\w{{1,5}}\s*[:.]?\s*(\d[\d.,]*)\s*m", text, _A)
    said = area(r"b[.)]?\s*") or area("")
    first = said and re.match(r"\d+(?:\.\d+)?", said[1].replace(",", "."), _A)
    n = stated if 2 <= stated <= t_.MOST_ROWS else 0
    if not n and not outline and any(w in text + "\n" for w in t_.SHEET_WORDS) and any(w in text + "\n" for w in t_.PARCEL_WORDS) and "dien tich" in text:
        areas = len(set(_patterns()[1].findall(text)))
        n = areas if areas >= 2 else 0
    return n, float(first[0]) if first else None


def _medians(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, key))
    keys, start, count = np.unique(key[order], return_index=True, return_counts=True)
    v = value[order]
    low, high = v[start + (count - 1) // 2], v[start + count // 2]
    return keys, np.where(low == high, low, 0.5 * low + 0.5 * high)


def _edges(mid: np.ndarray, width: np.ndarray, scale: np.ndarray) -> tuple[dict, dict]:
    """Each column's edges by page; as ``tables.detect_columns``."""
    first = lambda arrays: functools.reduce(lambda a, b: np.where(np.isnan(a), b, a), arrays, np.full(len(width), np.nan))
    enough, left, right = (~np.isnan(mid)).sum(1) >= 3, {}, {}
    for i, c in enumerate(NAMES):
        low, high = t_.COLUMNS[c]
        own = mid[:, i]
        there = enough & ~np.isnan(own)
        before, after = first([mid[:, j] for j in reversed(range(i))]), first([mid[:, j] for j in range(i + 1, len(NAMES))])
        nothing = np.full(len(width), np.nan)
        left[c] = first([np.where(there, (before + own) / 2, np.nan), nothing if low is None else low * scale, np.where(there, 0.0, np.nan)])
        right[c] = first([np.where(there, (after + own) / 2, np.nan), nothing if high is None else width if c == "nguon_goc" else high * scale, np.where(there, width, np.nan)])
    return left, right


def _carried(rows: list[tuple]) -> list[tuple]:
    """As ``tables.carry_sheets``."""
    known, out = [], []
    for sheet, parcel, glued in rows:
        lead = next((k for k in known if glued is not None and glued.startswith(k) and len(glued) > len(k)), None)
        if lead is not None:
            sheet, parcel = lead, glued[len(lead) :]
        if sheet is not None and sheet not in known:
            known.append(sheet)
        out.append((sheet if sheet is not None else known[0] if known else None, parcel))
    return out


def _numbers(left: list[tuple], edge: float) -> tuple:
    """sheet, parcel and glued of a row's left cells, (middle, properties) each: a sheet and parcel in one cell, else two cells, else one by its place; glued is a number of four digits and more, whose sheet may be known from the rows above."""
    joint = next((p[13] for _, p in reversed(left) if p[13]), None)
    single = [(x, p[0]) for x, p in left if p[6]]
    if joint:
        return *joint, None
    glued = next((p[0] for _, p in left if p[14]), None)
    if len(single) >= 2:
        return single[0][1], single[1][1], glued
    if single:
        return (single[0][1], None, glued) if single[0][0] <= edge else (None, single[0][1], glued)
    return None, None, glued


def read_pages(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        if batch.num_rows:
            if len(known) > MOST_TEXTS:
                known.clear()
            for k in range(0, batch.num_rows, MOST_PAGES):
                yield from _read(batch.slice(k, MOST_PAGES), schema, known)


def _read(batch: pa.RecordBatch, schema: list[str], known: dict) -> Iterator[pa.RecordBatch]:
    lists = batch.column(2)
    page = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
    ord_, text, x1, y1, x2, y2 = lists.flatten().flatten()
    coded = text.dictionary_encode()
    code = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    props = [known[t] if t in known else known.setdefault(t, _properties(t)) for t in [*coded.dictionary.to_pylist(), None]]
    ord_ = ord_.to_numpy(zero_copy_only=False)
    x1, y1, x2, y2 = (c.to_numpy(zero_copy_only=False).astype(float) for c in (x1, y1, x2, y2))
    prop = lambda i: np.array([p[i] for p in props])[code]
    # the pages that have a table, with their totals
    total, area, stated, blank = np.zeros(batch.num_rows, int), {}, prop(3), prop(2)
    said = np.flatnonzero((stated >= 0) & ~blank)
    said = said[np.lexsort((ord_[said], page[said]))]
    at, first = np.unique(page[said], return_index=True)
    found = np.full(batch.num_rows, -1)
    found[at] = stated[said][first]
    total[(found >= 2) & (found <= t_.MOST_ROWS)] = found[(found >= 2) & (found <= t_.MOST_ROWS)]
    by_text = np.zeros(batch.num_rows, bool)
    by_text[page[prop(4)]] = True
    start = np.searchsorted(page, np.arange(batch.num_rows + 1))
    for p in np.flatnonzero(by_text):
        own = [i for i in range(start[p], start[p + 1]) if not blank[i]]
        lines = [f for _, _, f in sorted((ord_[i], props[code[i]][0], props[code[i]][1]) for i in own)]
        total[p], area[p] = _page_totals(lines, int(found[p]))
    chosen = np.flatnonzero(total)
    if not len(chosen):
        return
    keep = total[page] > 0
    page, code, ord_, x1, y1, x2, y2, blank = np.searchsorted(chosen, page[keep]), code[keep], ord_[keep], x1[keep], y1[keep], x2[keep], y2[keep], blank[keep]
    n, m = total[chosen], len(chosen)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    start = np.searchsorted(page, np.arange(m))
    width = np.fmax(1000.0, np.fmax.reduceat(x2, start) + 50)
    scale = width / t_.PAGE_WIDTH
    s = scale[page]
    # columns
    kind = prop(5)
    head = (y1 >= t_.HEADING_BAND[0] * s) & (y1 <= t_.HEADING_BAND[1] * s) & (kind >= 0)
    both = head & (kind == KINDS.index("dien_tich"))
    one = head & ~both
    column = np.array([NAMES.index(k) if k in NAMES else -1 for k in KINDS])
    places = [(page[one], column[kind[one]], cx[one]), (page[both], np.full(both.sum(), NAMES.index("dien_tich_rieng")), cx[both] + -25 * s[both]), (page[both], np.full(both.sum(), NAMES.index("dien_tich_chung")), cx[both] + 25 * s[both])]
    key, median = _medians(np.concatenate([p * len(NAMES) + c for p, c, _ in places]), np.concatenate([v for *_, v in places]))
    mid = np.full((m, len(NAMES)), np.nan)
    mid.reshape(-1)[key] = median
    sheet, parcel, private = (NAMES.index(c) for c in ("to_ban_do", "so_thua", "dien_tich_rieng"))
    short = np.isnan(mid[:, sheet]) | np.isnan(mid[:, parcel])
    limit = np.where(np.isnan(mid[:, private]), 250.0 * scale, mid[:, private])
    number = short[page] & (y1 >= t_.NUMBER_BAND[0] * s) & (y1 <= t_.NUMBER_BAND[1] * s) & (cx < limit[page] - 10) & prop(6)
    if number.any():
        order = np.lexsort((cx[number], page[number]))
        p, x = page[number][order], cx[number][order]
        new = np.r_[True, (p[1:] != p[:-1]) | (x[1:] - x[:-1] > 25.0)]
        group = np.cumsum(new) - 1
        _, centre = _medians(group, x)
        of = p[new]
        second = np.flatnonzero(np.r_[False, of[1:] == of[:-1]] & ~np.r_[False, False, of[2:] == of[:-2]][: len(of)])
        mid[of[second], sheet], mid[of[second], parcel] = centre[second - 1], centre[second]
    left, right = _edges(mid, width, scale)
    L, R = (lambda c: left[c][page]), (lambda c: right[c][page])  # noqa: E731, N806
    # the table's top and bottom
    high = y1 < t_.BELOW_HEADINGS * s
    areas, others = prop(7) & high, prop(8) & high
    most = lambda where: np.fmax.reduceat(np.where(where, y2, np.nan), start)
    top, other = most(areas), most(others)
    top = np.where(np.isnan(top), np.where(np.isnan(other), t_.DEFAULT_TOP * scale, other), top)
    bottom = np.fmin.reduceat(np.where(prop(9) & ~areas, y1, np.nan), start)
    bottom = np.where(np.isnan(bottom), t_.DEFAULT_BOTTOM * scale, bottom)
    body = (cy >= top[page] + 5) & (cy <= bottom[page] - 5)
    # rows
    value = prop(10)
    over = body & ~np.isnan(value) & (((cx >= L("dien_tich_rieng") - 30) & (cx <= R("dien_tich_chung") + 30)) | ((x1 < R("dien_tich_chung") + 30) & (x2 > L("dien_tich_rieng") - 30)))
    found_at = np.flatnonzero(over)
    found_at = found_at[np.lexsort((value[found_at], ord_[found_at], cy[found_at], page[found_at]))]
    anchors: dict[int, list] = {}
    for p, y, a in zip(page[found_at].tolist(), cy[found_at].tolist(), value[found_at].tolist(), strict=True):
        kept = anchors.setdefault(p, [])
        if not kept or y - kept[-1][0] > 15.0:
            kept.append((y, a))
    of_page, low, up, anchor, first_row = [], [], [], [], {}
    for p in np.unique(page[body]).tolist():
        kept, k, a, b = anchors.get(p, []), int(n[p]), float(top[p]), float(bottom[p])
        first_row[p] = len(low)
        if len(kept) == k:
            between = [(x[0] + y[0]) / 2 for x, y in zip(kept, kept[1:], strict=False)]
            low += [a, *between]
            up += [*between, b]
        else:
            step = (b - a) / k
            low += [a + i * step for i in range(k)]
            up += [a + (i + 1) * step for i in range(k)]
        of_page += [p] * k
        anchor += [kept[i][1] if i < len(kept) else None for i in range(k)]
    rows = len(low)
    if not rows:
        return
    # a token is in the last row of its page that begins at or above it
    inside = np.flatnonzero(body & ~blank)
    merged = np.lexsort((np.r_[np.zeros(rows), np.ones(len(inside))], np.r_[low, cy[inside]], np.r_[of_page, page[inside]]))
    last = np.maximum.accumulate(np.where(merged < rows, merged, -1))
    row = np.empty(len(inside), int)
    row[merged[merged >= rows] - rows] = last[merged >= rows]
    fits = (row >= 0) & (np.array(of_page)[row] == page[inside]) & (cy[inside] < np.array(up)[row])
    row, i = row[fits], inside[fits]
    order = np.lexsort((cx[i], ord_[i], x1[i], row))
    row, i = row[order], i[order]
    cx, x1, x2, page, code = cx[i], x1[i], x2[i], page[i], code[i]
    is_left = cx < R("so_thua") + 15
    is_address = ~is_left & (cx >= L("dia_chi") - 10) & (cx < L("dien_tich_rieng") - 10) & ~prop(11)
    is_area = ((cx >= L("dien_tich_rieng") - 20) & (cx <= R("dien_tich_chung") + 30)) | ((x1 < R("dien_tich_chung")) & (x2 > L("dien_tich_rieng")))
    is_purpose = (cx >= L("muc_dich") - 10) & (cx < L("thoi_han")) & ~prop(12)
    is_term = (cx >= L("thoi_han")) & (cx < L("nguon_goc"))
    shared = np.maximum(0.0, np.minimum(x2, R("nguon_goc")) - np.maximum(x1, L("nguon_goc")))
    is_origin = (cx >= L("nguon_goc")) | (shared >= np.maximum(12.0, 0.55 * (x2 - x1)))
    lefts: list[list] = [[] for _ in range(rows)]
    for r, x, k in zip(row[is_left].tolist(), cx[is_left].tolist(), code[is_left].tolist(), strict=True):
        lefts[r].append((x, props[k]))
    value = prop(10)
    for r, v in zip(row[is_area & ~np.isnan(value)].tolist(), value[is_area & ~np.isnan(value)].tolist(), strict=True):
        anchor[r] = v  # the last one of the row
    texts = {}
    for name, where, sep in (("address", is_address, ", "), ("purpose", is_purpose, " "), ("term", is_term, " "), ("origin", is_origin, " ")):
        texts[name] = out = [""] * rows
        seen: set = set()
        for r, k in zip(row[where].tolist(), code[where].tolist(), strict=True):
            out[r] = out[r] + sep + props[k][0] if r in seen else props[k][0]
            seen.add(r)
    edge = right["to_ban_do"].tolist()
    kept_rows, number, sheets, parcels, pages = [], [], [], [], []
    for p, begin in first_row.items():
        carried = _carried([_numbers(lefts[r], edge[p]) for r in range(begin, begin + int(n[p]))])
        if any(parcel for _, parcel in carried):
            kept_rows += range(begin, begin + len(carried))
            number += range(1, len(carried) + 1)
            sheets += [x for x, _ in carried]
            parcels += [x for _, x in carried]
            pages += [int(chosen[p])] * len(carried)
    if kept_rows:
        at = pa.array(pages, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(sheets, pa.string()), pa.array(parcels, pa.string()), pa.array([anchor[r] for r in kept_rows], pa.float64())]
        columns += [pa.array([texts[c][r] for r in kept_rows], pa.string()) for c in ("address", "purpose", "term", "origin")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total[pages], pa.int32()), pa.array([area.get(p) for p in pages], pa.float64())], names=schema)
